from webloom.operators import stylesheets


def css(df, path, column):
    return df.where(f"path = '{path}'").first()[column]


def test_imports(sheet_table):
    sheets = sheet_table(
        ("css/root.css", 'a{} @import "b.css"; z{} @import url("gone.css");@import "https://o.org/x.css";'),
        ("css/b.css", '@import "sub/c.css"; b{}'),
        ("css/sub/c.css", '@import "b.css"; c{} @import "/css/b.css";'),
        ("self.css", '@import "self.css"; s{}'),
        ("plain.css", "p{}"),
    )
    done = stylesheets.inline_imports(sheets).cache()
    assert css(done, "css/root.css", "inlined") == (
        "a{} /* INLINED: b.css */\n/* INLINED: sub/c.css */\n"
        '/* @import "b.css" - CIRCULAR REFERENCE SKIPPED */\n c{} /* @import "/css/b.css" - FILE NOT FOUND */\n'
        ' b{} z{} /* @import "gone.css" - FILE NOT FOUND */\n'
        '/* External @import "https://o.org/x.css" stripped for offline use */'
    )
    assert css(done, "css/root.css", "n_inlined") == 2
    assert css(done, "self.css", "inlined") == (
        '/* INLINED: self.css */\n/* @import "self.css" - CIRCULAR REFERENCE SKIPPED */\n s{} s{}'
    )
    assert css(done, "plain.css", "inlined") == "p{}"


def test_paths_above_the_site_and_empty_sheets(sheet_table):
    sheets = sheet_table(
        ("s/a.css", '@import "../../b.css";@import "../b.css";@import "../x/../../b.css";@import "../none.css";'),
        ("b.css", "b{}"),
        ("none.css", ""),
    )
    done = stylesheets.inline_imports(sheets)
    assert css(done, "s/a.css", "inlined") == (
        '/* @import "../../b.css" - FILE NOT FOUND */\n/* INLINED: ../b.css */\nb{}'
        '/* @import "../x/../../b.css" - FILE NOT FOUND */\n/* INLINED: ../none.css */\n'
    )


def test_nul_characters_stay(sheet_table):
    from pyspark.sql import functions as F

    text = stylesheets.absolute_to_relative(F.col("css"), F.lit("../"))
    df = sheet_table(("s/a.css", 'x{y:"\0z"} a{b:url("/i.png")}'))
    assert df.select(text.alias("t")).first().t == 'x{y:"\0z"} a{b:url("../i.png")}'


def test_depth_limit(sheet_table):
    chain = [(f"{n}.css", f'@import "{n + 1}.css";r{n}{{}}') for n in range(14)] + [("14.css", "end{}")]
    done = stylesheets.inline_imports(sheet_table(*chain))
    text = css(done, "0.css", "inlined")
    assert '/* @import "11.css" - MAX DEPTH REACHED */' in text and "r10{}" in text and "r11{}" not in text


def test_all_steps(spark, sheet_table):
    sheets = sheet_table(
        ("c/d/a.css", """@import url("https://fonts.googleapis.com/css?family=A");
a{b:url("https://cdn.org/a.png?v=1")} c{d:url( https://cdn.org/other.png )} e{f:url('/i/x.png')} g{h:url(rel.png)}"""),
    )
    mapping = spark.createDataFrame([("example.com", "https://cdn.org/a.png", "a.png")], "target_domain string, url string, filename string")
    row = stylesheets.rewrite_stylesheets(sheets, mapping).first()
    assert row.new_css == """/* Google Fonts @import stripped for offline use */
a{b:url("../../images/a.png")} c{d:url("about:blank") /* External URL stripped for offline use */} e{f:url('../../i/x.png')} g{h:url(rel.png)}"""
    assert row.steps_applied == 5 and row.fonts_stripped and row.urls_stripped and row.failures == []
