"""SQL for DuckDB that gives the same rows as the registered queries.

Written on its own: other tag patterns (RE2 has neither look-around nor back-references), string
lists instead of array functions, recursive queries instead of rounds, and ranks by plain windows.
"""

from __future__ import annotations

from checks.site_fixture import NESTED, NUMBERED, PAGES, RULES, SHEETS

# --- literals and expressions ---------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TAG = r"""<[A-Za-z][^\s/>"']*[^'">]*(?:"[^"]*"[^'">]*|'[^']*'[^'">]*)*>"""
RAW = [rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in ("script", "style", "textarea", "title")]
ITEM = "(?is)" + "|".join(["<!--.*?-->", *RAW, TAG])
IMPORT = r"""@import\s+(?:url\(\s*)?["']([^"']+)["'](?:\s*\))?;"""
# Extensions of saved files and of media, and the style added to pages.
KNOWN = (
    ".css", ".js", ".html", ".htm", ".json", ".xml", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg",
    ".ico", ".bmp", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".mp4", ".webm", ".avi", ".mkv", ".mov",
    ".mp3", ".pdf",
)
MEDIA = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp4", ".webm", ".avi", ".mkv", ".mov", ".svg", ".ico",
    ".bmp", ".css", ".js", ".woff2",
)
PATTERNS = r"action=|Special:|sort=|f=[0-9]+&"
STYLE = """<style>/* Minimal fallback CSS for offline browsing */
body { font-family: Arial, sans-serif; line-height: 1.6; margin: 0; padding: 0; }
#content { max-width: 960px; margin: 0 auto; padding: 20px; }
h1, h2, h3 { margin-top: 1.5em; }
a { color: #0645ad; text-decoration: none; }
a:hover { text-decoration: underline; }
.mw-body-content { padding: 1em; }</style>"""


def rx(column: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({column}, {q(pattern)}, {group})"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def sub(column: str, pattern: str, new: str, flags: str = "g") -> str:
    return f"regexp_replace({column}, {q(pattern)}, {q(new)}, '{flags}')"


def host(u: str) -> str:
    return f"lower({rx(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)})"


def url_path(u: str) -> str:
    return rx(u, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def decode(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def attribute(tag: str, name: str) -> str:
    value = rx(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""", 1)
    unquoted = sub(value, """^["']|["']$""", "")
    return decode(unquoted)


def dots(p: str) -> str:
    """Fold dot segments of a path."""
    parts = f"""(string_split({p}, '/') || CASE WHEN {has(p, r'(^|/)[.][.]?$')} THEN [''] ELSE [] END)"""
    folded = f"""list_reduce(list_transform({parts}, lambda x: [x]), lambda a, b:
        CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END)"""
    return f"""CASE WHEN {has(p, r'(^|/)[.][.]?(/|$)')} THEN array_to_string({folded}, '/') ELSE {p} END"""


def resolve(base: str, ref: str) -> str:
    root = rx(base, "^[a-z]+://[^/?#]*")
    base_path = url_path(base)
    path = rx(ref, "^[^?#]*")
    tail = f"substr({ref}, length({path}) + 1)"
    folder = f"CASE WHEN {base_path} = '' THEN '/' ELSE {sub(base_path, '[^/]*$', '')} END"
    merged = f"""CASE WHEN {path} LIKE '/%' THEN {path}
        ELSE regexp_replace({folder} || {path}, '/{{2,}}', '/', 'g') END"""
    absolute = f"""(SELECT CASE WHEN d LIKE '/%' THEN d ELSE '/' || d END
        FROM (SELECT {dots('m')} AS d FROM (SELECT {merged} AS m)))"""
    return f"""CASE WHEN {ref} = '' THEN {base}
        WHEN {has(ref, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN {ref}
        WHEN {ref} LIKE '//%' THEN {rx(base, '^[a-z]+:')} || {ref}
        WHEN {ref} LIKE '#%' THEN {sub(base, '#.*$', '')} || {ref}
        WHEN {ref} LIKE '?%' THEN {root} || {base_path} || {ref}
        ELSE {root} || {absolute} || {tail} END"""


def plain_path(u: str) -> str:
    return sub(url_path(u), ";[^/]*$", "")


def file_path(u: str) -> str:
    p = plain_path(u)
    named = f"CASE WHEN {p} = '' OR {p} LIKE '%/' THEN {p} || 'index.html' ELSE {p} END"
    clean = f"ltrim(regexp_replace({named}, '/{{2,}}', '/', 'g'), '/')"
    query = rx(u, r"^[^?#]*\?([^#]*)", 1)
    return f"{clean} || CASE WHEN {query} <> '' THEN '@' || replace({query}, '/', '%2F') ELSE '' END"


def save_path(p: str) -> str:
    known = has(p, rf"(?i)[^/](?:{'|'.join(n.replace('.', '[.]') for n in KNOWN)})$")
    return f"CASE WHEN {known} THEN {p} ELSE {p} || '.html' END"


def local(u: str) -> str:
    return f"(SELECT {save_path('f')} FROM (SELECT {file_path(u)} AS f))"


def is_media(u: str, names=MEDIA) -> str:
    return has(u, rf"(?i)(?:{'|'.join(n.replace('.', '[.]') for n in names)})(?:\?.*)?$")


def basename(u: str) -> str:
    return rx(plain_path(u), "([^/]+)/*$", 1)


def navigable(r: str) -> str:
    return f"NOT {has(r, '^(#|javascript:|mailto:|data:)')}"


def kept(u: str, domain: str, patterns: bool = True) -> str:
    test = f"{navigable(u)} AND {has(u, '^(?i)https?:')} AND {host(u)} = {domain}"
    if patterns:
        test += f" AND NOT {has(u, PATTERNS)}"
        test += f" AND NOT (contains({host(u)}, 'analytics.') OR contains({host(u)}, 'matomo.'))"
    return test


def relative(target: str, start_folder: str) -> str:
    """Relative path by numbering the leading segments that agree."""
    to = f"list_filter(string_split({target}, '/'), lambda x: x <> '')"
    start = f"list_filter(string_split({start_folder}, '/'), lambda x: x <> '')"
    return f"""(SELECT rtrim(repeat('../', len(s) - c) || array_to_string(t[c + 1:], '/'), '/') FROM (
        SELECT t, s, len(list_filter(range(1, least(len(t), len(s)) + 1), lambda n: t[1:n] = s[1:n])) AS c
        FROM (SELECT {to} AS t, {start} AS s)))"""


def up(path: str) -> str:
    return f"repeat('../', length({path}) - length(replace({path}, '/', '')))"


# --- named parts of queries -----------------------------------------------------------------


def attrs_of(tags: str, wanted: dict[str, str]) -> str:
    """One SELECT per attribute; ``wanted`` maps the attribute to the tags it is read from."""
    return " UNION ALL ".join(
        f"""SELECT page_id, url, target_domain, path, pos, tag, '{a}' AS attr, raw FROM (
            SELECT *, {attribute('markup', a)} AS raw FROM {tags} WHERE regexp_matches(tag, '^({names})$'))
            WHERE raw <> ''"""
        for a, names in wanted.items()
    )


SIX = "img|script|link|video|audio|source"
LINK_ATTRS = {"href": "a|link", "src": "img|script|video|audio|source", "data-src": "img|source"}


def items_of(pages: str) -> str:
    found = f"regexp_extract_all(html, {q(ITEM)})"
    return f"""SELECT page_id, url, target_domain, path, unnest({found}) AS item,
        generate_subscripts({found}, 1) - 1 AS pos FROM {pages}"""


def tags_of(items: str) -> str:
    return f"""SELECT *, lower({rx('item', '^<([A-Za-z][A-Za-z0-9]*)', 1)}) AS tag,
        {rx('item', '(?is)^' + TAG)} AS markup FROM {items} WHERE item NOT LIKE '<!--%'"""


def links_of(attrs: str, rules: bool = True) -> str:
    return f"""SELECT *, {sub('abs_url', '#.*$', '')} AS norm_url FROM (
        SELECT *, {resolve('url', 'raw')} AS abs_url FROM {attrs} WHERE {navigable('raw')})
        WHERE {kept('abs_url', 'target_domain', rules)}"""


def media_of(values: str, names=None, extensions=MEDIA) -> str:
    test = names or is_media("raw", extensions)
    return f"""SELECT DISTINCT target_domain, {sub('raw', r'[?].*$', '')} AS url FROM {values}
        WHERE regexp_matches(raw, '^https?://') AND {host('raw')} <> target_domain AND {test}"""


CSS_URL = r"""url\(\s*["']?(https?://[^"'\\)]+)["']?\s*\)"""
MAPPED = r"""url\(\s*(["']?)(https?://[^\s"'?#>\)\\]+)(\?[^\s"'#>\)]+)?["']?\s*\)"""
EDIT_TARGET = r"""(?is)^(.*?[\s"'/]{0}\s*=\s*)("[^"]*"|'[^']*'|[^\s>]*)(.*)$"""


def encode(x: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, {q(char)}, {q(entity)})"
    return x


def with_value(item: str, name: str, value: str) -> str:
    pattern = EDIT_TARGET.format(name)
    return f"""CASE WHEN {value} IS NULL THEN {item} ELSE {rx(item, pattern, 1)} || '"' || {encode(value)}
        || '"' || {rx(item, pattern, 3)} END"""


def cors_free(item: str) -> str:
    gone = r"""(?is)[\s/]*\s{0}\s*=\s*("[^"]+"|'[^']+'|[^\s>"']+)"""
    once = sub(item, gone.format("integrity"), "", "")
    return f"""CASE WHEN regexp_matches({item}, '(?i)^<(link|script|img)[\\s/>]')
        THEN {sub(once, gone.format('crossorigin'), '', '')} ELSE {item} END"""


def spliced(pages: str, items: str, new: str, joins: str = "") -> str:
    """Pages put together again from gaps and (changed) items."""
    gaps = f"string_split_regex(html, {q(ITEM)})"
    return f"""SELECT g.page_id, string_agg(gap || coalesce({new}, ''), '' ORDER BY g.pos) AS new_html FROM (
          SELECT page_id, unnest({gaps}) AS gap, generate_subscripts({gaps}, 1) - 1 AS pos FROM {pages}) g
        LEFT JOIN {items} i ON i.page_id = g.page_id AND i.pos = g.pos {joins} GROUP BY g.page_id"""


def edit_joins(*tables: str) -> str:
    return " ".join(
        f"""LEFT JOIN (SELECT page_id, pos, max(value) FILTER (attr = 'href') AS href,
            max(value) FILTER (attr = 'src') AS src FROM {t} GROUP BY ALL) {t}_e
            ON {t}_e.page_id = g.page_id AND {t}_e.pos = g.pos"""
        for t in tables
    )


def edited(tables: list[str], cors: str | None) -> str:
    """The item with its new values; ``cors`` is the condition for dropping CORS attributes."""
    item = f"CASE WHEN {cors} THEN {cors_free('i.item')} ELSE i.item END" if cors else "i.item"
    href = "coalesce(" + ", ".join(f"{t}_e.href" for t in tables) + ")"
    src = "coalesce(" + ", ".join(f"{t}_e.src" for t in tables) + ")"
    return f"""(SELECT {with_value('w', 'src', src)} FROM (
        SELECT {with_value('v', 'href', href)} AS w FROM (SELECT {item} AS v)))"""


BODY = rx("html", r"(?is)<body[^>]*>(.*)$", 1)


def visible(markup: str) -> str:
    bare = sub(markup, r"(?is)<!--.*?-->|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<template\b.*?(?:</template\s*>|\z)", "<x>")
    nodes = f"string_split_regex({bare}, '</?[A-Za-z!][^>]*>')"
    texts = f"list_transform({nodes}, lambda n: trim({decode('n')}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)))"
    return f"array_to_string(list_filter({texts}, lambda n: n <> ''), ' ')"


def checks_of(pages: str) -> str:
    return f"""SELECT *, NOT (missing_head OR missing_body OR empty_body OR has_binary_content) AND html <> '' AS valid
      FROM (SELECT *, html <> '' AND NOT {has('html', '(?i)<head[^>]*>')} AS missing_head,
        html <> '' AND NOT {has('html', '(?i)<body[^>]*>')} AS missing_body,
        {has('html', '(?i)<body[^>]*>')} AND length({visible(BODY)}) < 5 AS empty_body,
        {has('html', r'[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')} AS has_binary_content FROM {pages})"""


def removable(tag: str, markup: str, body: str) -> dict[int, str]:
    """Condition on link and script items, rule by rule."""
    rel, kind = attribute(markup, "rel"), attribute(markup, "type")
    href, src = attribute(markup, "href"), attribute(markup, "src")
    token = "(^|\\s){0}(\\s|$)"
    return {
        1: f"{tag} = 'link' AND {has(rel, token.format('stylesheet'))} AND {has(href, '^https?://.*load[.]php')}",
        2: f"{tag} = 'script' AND {has(src, '^https?://.*load[.]php')}",
        3: f"{tag} = 'link' AND {has(rel, token.format('preconnect'))}",
        4: f"{tag} = 'link' AND {has(rel, token.format('dns-prefetch'))}",
        5: f"{tag} = 'link' AND {has(rel, token.format('EditURI'))}",
        6: f"{tag} = 'link' AND {has(kind, 'application/(atom|rss)[+]xml')}",
        7: f"{tag} = 'script' AND contains({body}, '_paq')",
        8: f"{tag} = 'script' AND {has(src, '(?i)google-analytics[.]com')}",
        9: f"{tag} = 'script' AND {has(body, '(?i)google-analytics[.]com')}",
        11: f"{tag} = 'script' AND {has(src, '9a832b96e0[.]js')}",
        12: f"{tag} = 'link' AND {has(href, '(?i)use[.]fontawesome[.]com')}",
        13: f"{tag} = 'script' AND contains({body}, 'FontAwesomeCdnConfig')",
        14: f"{tag} = 'script' AND {has(body, '''ga[(]['"]create['"]''')}",
        15: f"{tag} = 'script' AND {has(body, '''ga[(]['"]send['"]''')}",
    }


FIRST_RULE = "CASE " + " ".join(
    f"WHEN {t} THEN {n}" for n, t in removable("tag", "markup", "body").items()) + " END"
# Text that is not markup comes first in a search for elements, so that what is in it is passed over.
MASKED = "|".join(["<!--.*?-->", *RAW])
NOSCRIPT = rf"(?is){MASKED}|<noscript[^>]*>.*?</noscript\s*>"
PIXEL = r"""(?is)^<noscript.*<img[^>]*\ssrc=["']?[^"'>]*(?:matomo|analytics|doubleclick|google-analytics)"""
FORUM_LINK = rf"(?is){MASKED}|<a\s[^>]*>.*?</a\s*>"
FORUM = r"""(?is)^<a\s[^>]*href=["'][^"'>]*(?:posting|tradegold|memberlist|search|ucp|mcp)[.]php"""


def without(text: str, pattern: str, gone: str) -> str:
    """(rest, number): the text without those matches of ``pattern`` for which ``gone`` holds on x."""
    return f"""(SELECT {{'rest': array_to_string(list_transform(range(1, len(g) + 1), lambda k: g[k] || coalesce(
          CASE WHEN d[k] THEN '' ELSE i[k] END, '')), ''), 'n': len(list_filter(d, lambda z: z))}}
        FROM (SELECT g, i, list_transform(i, lambda x: coalesce({gone}, false)) AS d FROM (
          SELECT string_split_regex({text}, {q(pattern)}) AS g, regexp_extract_all({text}, {q(pattern)}) AS i)))"""


def removal_of(pages: str) -> str:
    """Pages after the rules in their order, and how many elements went."""
    rules = removable(
        f"lower({rx('x', '^<([A-Za-z][A-Za-z0-9]*)', 1)})",
        rx("x", "(?is)^" + TAG),
        rx("x", "(?is)^<script[^>]*>(.*)</script", 1),
    )
    early = " OR ".join(f"({t})" for n, t in rules.items() if n < 10)
    late = " OR ".join(f"({t})" for n, t in rules.items() if n > 10)
    a = f"SELECT page_id, {without('html', ITEM, early)} AS a FROM {pages}"
    b = f"SELECT *, {without('a.rest', NOSCRIPT, has('x', PIXEL))} AS b FROM ({a})"
    c = f"SELECT *, {without('b.rest', ITEM, late)} AS c FROM ({b})"
    d = f"SELECT *, {without('c.rest', FORUM_LINK, has('x', FORUM))} AS d FROM ({c})"
    return f"SELECT page_id, d.rest AS new_html, a.n + b.n + c.n + d.n AS removed FROM ({d})"


HEAD_START = r"(?is)^(\s|<!--.*?-->|<!doctype[^>]*>|<html[^>]*>)*<(head|link|meta|script|style|title|base)[\s/>]"


def styled(text: str) -> str:
    before = f"""regexp_replace({text}, '(?i)({{0}})', {q(STYLE + chr(92) + '1')})"""
    return f"""CASE WHEN contains({text}, '/* Minimal fallback CSS for offline browsing */') THEN {text}
        WHEN {has(text, '(?i)</head\\s*>')} THEN {before.replace('{0}', '</head\\s*>')}
        WHEN NOT {has(text, HEAD_START)} THEN {text}
        WHEN {has(text, '(?i)<body[\\s>]')} THEN {before.replace('{0}', '<body[\\s>]')}
        ELSE {q(STYLE)} || {text} END"""


def scripts_cleaned(text: str) -> str:
    for p in (
        r"""ga\(['"]create['"],\s*[^)]+\);?""",
        r"""ga\(['"]send['"],\s*[^)]+\);?""",
        r"""\.push\(\s*\[?\s*['"]trackPageView['"].*?\);?""",
        r"""\.push\(\s*\[?\s*['"]enableLinkTracking['"].*?\);?""",
        r"""(?s)window\.FontAwesomeCdnConfig\s*=\s*\{[^}]+\}\s*;""",
    ):
        text = sub(text, p, "")
    return text


CTES: dict[str, str] = {
    "site": f"SELECT *, {local('url')} AS path FROM ({PAGES})",
    "raw": f"SELECT *, {local('url')} AS path FROM (SELECT page_id, url, {host('url')} AS target_domain, html FROM pages)",
    "sheets": SHEETS,
    "items": items_of("site"),
    "raw_items": items_of("raw"),
    "tags": tags_of("items"),
    "raw_tags": tags_of("raw_items"),
    "attrs": attrs_of("tags", LINK_ATTRS),
    "raw_attrs": attrs_of("raw_tags", LINK_ATTRS),
    "media_attrs": attrs_of("tags", dict.fromkeys(("href", "src", "data-src"), SIX)),
    "refs": f"SELECT *, {resolve('url', 'raw')} AS abs_url FROM (SELECT DISTINCT page_id, url, target_domain, raw FROM attrs)",
    "links": links_of("attrs"),
    "raw_links": links_of("raw_attrs"),
    "css_values": f"SELECT target_domain, unnest(regexp_extract_all(css, {q(CSS_URL)}, 1)) AS raw FROM sheets",
    "css_edges": f"""SELECT DISTINCT target_domain, src_url, dst_url FROM (
        SELECT target_domain, url AS src_url, {resolve('url', 'ref')} AS dst_url FROM (
          SELECT target_domain, url, unnest(regexp_extract_all(css, {q(IMPORT)}, 1)) AS ref FROM sheets)
        WHERE NOT regexp_matches(ref, '^https?://')) WHERE {kept('dst_url', 'target_domain')}""",
    "edges": f"""SELECT DISTINCT target_domain, url AS src_url, norm_url AS dst_url FROM links
        WHERE {has('path', '(?i)[.]html?$')} UNION ALL SELECT * FROM css_edges""",
    "media": f"{media_of('media_attrs')} UNION {media_of('css_values')}",
    "files": f"""SELECT target_domain, 'images/' || {basename('url')} AS path,
        max(length(url) * 1000) AS length FROM media WHERE length(url) % 3 <> 0 GROUP BY ALL""",
    "url_map": f"""SELECT m.*, count(*) OVER (PARTITION BY m.target_domain, filename) > 1 AS shared FROM (
        SELECT *, {basename('url')} AS filename FROM media) m
        SEMI JOIN files f ON f.target_domain = m.target_domain AND f.path = 'images/' || m.filename""",
    "stored": """SELECT target_domain, path, octet_length(encode(html)) AS length FROM site WHERE page_id % 10 <> 7
        UNION ALL SELECT target_domain, path, octet_length(encode(css)) FROM sheets""",
    "everything": """SELECT target_domain, path, octet_length(encode(html)) AS length FROM site
        UNION ALL SELECT target_domain, path, octet_length(encode(css)) FROM sheets UNION ALL SELECT target_domain, path, length FROM files""",
    "seeds": "SELECT target_domain, arg_min(url, page_id) AS url FROM site GROUP BY ALL",
    "fetch_log": "SELECT *, length(url) % 6 AS status FROM media",
    "reach": """SELECT target_domain, url, 0 AS depth FROM seeds UNION
        SELECT r.target_domain, e.dst_url, r.depth + 1 FROM reach r
        JOIN edges e ON e.target_domain = r.target_domain AND e.src_url = r.url WHERE r.depth <= 40""",
    "walk": """SELECT target_domain, url, 0 AS depth FROM seeds UNION
        SELECT w.target_domain, e.dst_url, w.depth + 1 FROM walk w
        JOIN (SELECT * FROM edges ANTI JOIN (SELECT target_domain, url AS src_url FROM site WHERE page_id % 10 = 7) g
          USING (target_domain, src_url)) e ON e.target_domain = w.target_domain AND e.src_url = w.url WHERE w.depth < 4""",
    "reached": "SELECT target_domain, url, min(depth) AS depth FROM reach GROUP BY ALL",
    "status": f"""SELECT r.*, CASE WHEN s.path IS NULL THEN 'missing' ELSE 'present' END AS status FROM (
        SELECT *, {local('url')} AS path FROM reached WHERE depth <= 4) r
        LEFT JOIN (SELECT DISTINCT target_domain, path FROM stored) s USING (target_domain, path)""",
    "ext_edits": f"""SELECT a.page_id, a.pos, a.attr, {up('a.path')} || 'images/' || m.filename AS value
        FROM (SELECT *, {sub('raw', '[?].*$', '')} AS bare FROM ({attrs_of('tags', dict.fromkeys(('href', 'src'), 'link|script|img'))})) a
        JOIN url_map m ON m.target_domain = a.target_domain AND m.url = a.bare""",
    "media7": media_of("(SELECT target_domain, raw FROM media_attrs UNION ALL SELECT target_domain, raw FROM css_values)",
                       is_media("raw", ["7.png"])),
    "map7": f"""SELECT m.* FROM (SELECT *, {basename('url')} AS filename FROM media7) m
        SEMI JOIN files f ON f.target_domain = m.target_domain AND f.path = 'images/' || m.filename""",
    "edits7": f"""SELECT a.page_id, a.pos, a.attr, {up('a.path')} || 'images/' || m.filename AS value
        FROM attrs a JOIN map7 m ON m.target_domain = a.target_domain AND m.url = {sub('a.raw', '[?].*$', '')}
        WHERE regexp_matches(tag, '^(link|script|img)$') AND attr <> 'data-src'""",
    "pages7": spliced("site", "items", edited(["edits7"],
        "g.page_id IN (SELECT page_id FROM site SEMI JOIN media7 USING (target_domain))"), edit_joins("edits7")),
    "int_edits": f"""SELECT c.page_id, c.pos, c.attr, {relative('c.goal', sub('c.path', '/?[^/]*$', ''))} AS value FROM (
        SELECT *, {local('abs_url')} AS goal FROM (
          SELECT *, {resolve("('https://' || target_domain || '/' || path)", 'raw')} AS abs_url FROM (
            {attrs_of('tags', {'href': 'a|' + SIX, 'src': SIX})})
          WHERE {navigable('raw')} AND (tag = 'a' OR raw NOT LIKE '../%'))
        WHERE {kept('abs_url', 'target_domain', False)}) c
        JOIN (SELECT DISTINCT target_domain, path FROM stored) s ON s.target_domain = c.target_domain AND s.path = c.goal""",
    "ext_pages": spliced("site", "items", edited(["ext_edits"], "true"), edit_joins("ext_edits")),
    "int_pages": spliced("site", "items", edited(["int_edits"], None), edit_joins("int_edits")),
    "all_pages": spliced("site", "items", edited(["int_edits", "ext_edits"], "true"), edit_joins("int_edits", "ext_edits")),
    "cut": f"""SELECT target_domain, path, p % 2 = 1 AS is_import, p AS place, text FROM (
        SELECT target_domain, path, (generate_subscripts(t, 1) - 1) * 2 AS p, unnest(t) AS text FROM (
          SELECT target_domain, path, string_split_regex(css, {q(IMPORT)}) AS t FROM sheets)
        UNION ALL SELECT target_domain, path, generate_subscripts(i, 1) * 2 - 1, unnest(i) FROM (
          SELECT target_domain, path, regexp_extract_all(css, {q(IMPORT)}, 1) AS i FROM sheets))""",
    "inl": """SELECT target_domain, path, [place] AS k, is_import, text, []::VARCHAR[] AS stack, 0 AS n FROM cut
        UNION ALL
        SELECT o.target_domain, o.path, o.k || CASE WHEN stop IS NULL THEN [coalesce(c.place, -1)] ELSE []::BIGINT[] END,
          stop IS NULL AND coalesce(c.is_import, false),
          CASE WHEN stop IS NOT NULL THEN stop WHEN c.place IS NULL THEN '/* INLINED: ' || o.raw || ' */' || chr(10) ELSE c.text END,
          o.stack || [o.raw], CASE WHEN stop IS NULL AND c.place IS NULL THEN 1 ELSE 0 END
        FROM (SELECT i.target_domain, i.path, i.k, i.stack, i.text AS raw, i.goal,
            CASE WHEN regexp_matches(i.text, '^https?://') THEN '/* External @import "' || i.text || '" stripped for offline use */'
                 WHEN s.path IS NULL OR i.text LIKE '../../%' THEN '/* @import "' || i.text || '" - FILE NOT FOUND */' || chr(10)
                 WHEN list_contains(i.stack, i.text) THEN '/* @import "' || i.text || '" - CIRCULAR REFERENCE SKIPPED */' || chr(10)
                 WHEN len(i.stack) >= 10 THEN '/* @import "' || i.text || '" - MAX DEPTH REACHED */' || chr(10) END AS stop
          FROM (SELECT *, 's/' || replace(text, './', '') AS goal FROM inl WHERE is_import) i
          LEFT JOIN sheets s ON s.target_domain = i.target_domain AND s.path = i.goal) o
        LEFT JOIN (SELECT target_domain, path, place, is_import, text FROM cut
          UNION ALL SELECT target_domain, path, NULL, false, NULL FROM sheets) c
          ON c.target_domain = o.target_domain AND c.path = o.goal AND o.stop IS NULL""",
    "inlined": """SELECT target_domain, path, string_agg(text, '' ORDER BY k) AS inlined, sum(n)::BIGINT AS n_inlined
        FROM inl WHERE NOT is_import GROUP BY ALL""",
    "css_fonts": r"""SELECT *, regexp_replace(inlined, '/\* External @import "https://fonts[.]googleapis[.]com/[^"]+" stripped for offline use \*/',
        '/* Google Fonts @import stripped for offline use */', 'g') AS text FROM inlined""",
    "checked": checks_of("site"),
    "issues": " UNION ALL ".join(
        f"SELECT target_domain, path, '{n}' AS issue FROM checked WHERE {n}"
        for n in ("missing_head", "missing_body", "empty_body", "has_binary_content")
    ),
    "cleaned": removal_of("site"),
    "steps": f"""SELECT page_id, html, c1, 'HTML validation failed: ' || array_to_string(list_filter([
          CASE WHEN {has('html', '(?i)<body[^>]*>')} THEN 'missing <body>' END,
          CASE WHEN {has('html', '(?i)</body>')} THEN 'missing </body>' END], lambda x: x IS NOT NULL), ', ') AS e3, {sub('html', 'https://img[.]example[.]org', 'img')} AS t2,
        {sub(sub('html', 'https://img[.]example[.]org', 'img'), '(?i)</?body[^>]*>', '')} AS c3 FROM (
        SELECT *, {sub('html', r'(?i)</head[ ]*>', '')} AS c1 FROM site)""",
    "blocks": """SELECT page_id, b1 AS block, s, e, st, x FROM (SELECT page_id, page_id AS n,
        CASE WHEN n % 11 = 0 THEN (n % 7 + 5) || '..' || n % 3
             WHEN n % 13 = 0 THEN (n % 7 + 5) || '..' || n % 3 || '..-2' WHEN n % 17 = 0 THEN 'x..y'
             WHEN n % 5 = 0 THEN n % 7 || '..' || (n % 7 + n % 20) || '..3'
             WHEN n % 2 = 0 THEN n % 7 || '..' || (n % 7 + n % 20) || '%3, 5,9'
             ELSE n % 7 || '..' || (n % 7 + n % 20) END AS b1,
        CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN n % 7 + 5 WHEN n % 17 = 0 THEN NULL ELSE n % 7 END AS s,
        CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN n % 3 WHEN n % 17 = 0 THEN NULL ELSE n % 7 + n % 20 END AS e,
        CASE WHEN n % 11 = 0 THEN 1 WHEN n % 13 = 0 THEN -2 WHEN n % 17 = 0 THEN NULL WHEN n % 5 = 0 THEN 3 ELSE 1 END AS st,
        n % 11 <> 0 AND n % 13 <> 0 AND n % 17 <> 0 AND n % 5 <> 0 AND n % 2 = 0 AS x FROM pages)""",
    "ranged": """SELECT page_id, block, v FROM (SELECT page_id, block,
        list_filter(generate_series(s, e, st), lambda g: NOT (x AND g IN (3, 5, 9))) AS v FROM blocks) WHERE len(v) > 0""",
}

NEEDS: dict[str, list[str]] = {}


def _needs(text: str) -> list[str]:
    import re

    return [n for n in CTES if re.search(rf"\b(?:FROM|JOIN)\s+\(?{n}\b", text)]


def sql(final: str) -> str:
    """The final SELECT with the parts it uses, in order."""
    order: list[str] = []

    def add(text: str, own: str | None = None) -> None:
        for name in _needs(text):
            if name not in order and name != own:
                add(CTES[name], name)
                if name not in order:
                    order.append(name)

    add(final)
    if not order:
        return final
    parts = ",\n".join(
        f"{n} AS {'' if n in ('reach', 'inl', 'walk') else 'MATERIALIZED '}({CTES[n]})" for n in order
    )
    return f"WITH RECURSIVE {parts}\n{final}"


def mirrored(pages: str) -> str:
    """Cleaning of pages whose links are already rewritten."""
    base = f"(SELECT s.page_id, s.url, s.target_domain, s.path, p.new_html AS html FROM site s JOIN {pages} p USING (page_id))"
    return base


def cleaned_after(pages: str) -> str:
    linked = mirrored(pages)
    removal = removal_of("linked")
    return f"""WITH linked AS MATERIALIZED {linked},
        gone AS MATERIALIZED ({removal})
        SELECT page_id, new_html, removed, removed > 0 OR new_html <> (SELECT html FROM site s WHERE s.page_id = g.page_id) AS changed
        FROM (SELECT page_id, removed, {scripts_cleaned(styled('new_html'))} AS new_html FROM gone) g"""


def with_parts(final: str) -> str:
    """``sql`` for a final query that begins with its own WITH."""
    head = sql(final)
    return head if head is final else head.replace("\nWITH ", ",\n", 1)


def localized(text: str, source: str, mapping: str = "url_map") -> str:
    """Stylesheets whose mapped url() references are local."""
    refs, gaps = f"regexp_extract_all({text}, {q(MAPPED)})", f"string_split_regex({text}, {q(MAPPED)})"
    quote = rx("ref", MAPPED, 1)
    return f"""SELECT g.target_domain, g.path, string_agg(gap || coalesce(
          CASE WHEN m.url IS NULL THEN ref ELSE 'url(' || {quote} || {up('g.path')} || 'images/' || m.filename || {quote} || ')' END, ''),
          '' ORDER BY g.n) AS new_css
        FROM (SELECT target_domain, path, unnest({gaps}) AS gap, generate_subscripts({gaps}, 1) AS n FROM {source}) g
        LEFT JOIN (SELECT target_domain, path, unnest({refs}) AS ref, generate_subscripts({refs}, 1) AS n FROM {source}) r
          ON r.target_domain = g.target_domain AND r.path = g.path AND r.n = g.n
        LEFT JOIN {mapping} m ON m.target_domain = g.target_domain AND m.url = {rx('ref', MAPPED, 2)}
        GROUP BY g.target_domain, g.path"""


def neutral(text: str) -> str:
    return sub(text, r"""url\(\s*["']?https?://[^"'\\)]+["']?\s*\)""",
               'url("about:blank") /* External URL stripped for offline use */')


def rebased(text: str, path: str) -> str:
    """Absolute paths, one quote style at a time."""
    for quote in ('"', "'", ""):
        body = r"[^\"'\)]*"
        pattern = rf"url\(\s*{quote}/({body}){quote}\s*\)"
        new = f"{q('url(' + quote)} || {up(path)} || {q(chr(92) + '1' + quote + ')')}"
        text = f"regexp_replace({text}, {q(pattern)}, {new}, 'g')"
    return text


def rewritten(mapping: str) -> str:
    return f"""SELECT target_domain, path, s.css, f.text AS t2, l.new_css AS t3, {neutral('l.new_css')} AS t4,
    {rebased(neutral('l.new_css'), 'path')} AS new_css, n_inlined, inlined
    FROM sheets s JOIN css_fonts f USING (target_domain, path) JOIN ({localized('text', 'css_fonts', mapping)}) l USING (target_domain, path)"""


REWRITTEN = rewritten("url_map")
STEPS_APPLIED = """(inlined <> css)::INT + (t2 <> inlined)::INT + (t3 <> t2)::INT + (t4 <> t3)::INT + (new_css <> t4)::INT"""

RAW_FINALS: dict[str, str] = {
    # scans and sinks
    "page_scan": "SELECT page_id, url, target_domain, html FROM raw WHERE length(html) > 0",
    "stylesheet_scan": "SELECT * FROM sheets WHERE length(css) > 0",
    "token_table": f"""SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN 'gap' WHEN text LIKE '<!--%' THEN 'comment'
        WHEN tag IN ('script', 'style', 'textarea', 'title') THEN 'element' ELSE 'tag' END AS kind,
        CASE WHEN pos % 2 = 1 THEN tag ELSE '' END AS tag, text FROM (
        SELECT page_id, pos * 2 + 1 AS pos, item AS text, lower({rx('item', '^<([A-Za-z][A-Za-z0-9]*)', 1)}) AS tag FROM raw_items
        UNION ALL SELECT page_id, (generate_subscripts(g, 1) - 1) * 2, unnest(g), '' FROM (
          SELECT page_id, string_split_regex(html, {q(ITEM)}) AS g FROM pages)) WHERE text <> ''""",
    "token_round_trip": "SELECT page_id, true AS same FROM pages",
    "changed_pages": f"""SELECT page_id, new_html FROM (SELECT page_id, html, {styled('html')} AS new_html FROM site)
        WHERE new_html IS DISTINCT FROM html""",
    "failure_numbers": """SELECT printf('%05d', 7 + row_number() OVER (ORDER BY page_id, step_no)) AS number, page_id, step, error FROM (
        SELECT page_id, 1 AS step_no, 'drop head end' AS step, 'HTML validation failed: missing </head>' AS error FROM steps WHERE c1 <> html
        UNION ALL SELECT page_id, 3, 'drop body', e3 FROM steps WHERE c3 <> t2)""",
    "folder_pages": "SELECT page_id, html FROM pages WHERE html <> ''",
    "folder_inventory": "SELECT page_id, octet_length(encode(html)) AS length FROM pages",
    "folder_stylesheets": """SELECT target_domain || '/' || path AS path, 'https://example.org/' || target_domain || '/' || path AS url,
        CASE WHEN length(css) % 11 = 0 THEN '' ELSE css END AS css FROM sheets""",
    "written_back": f"""SELECT page_id, n AS new_html FROM (
        SELECT page_id, {scripts_cleaned(styled('new_html'))} AS n FROM cleaned) WHERE n <> ''""",
    "failed_url_file": "SELECT url FROM fetch_log WHERE status <> 0",
    "loaded_settings": """SELECT (count(*) % 50 + 1)::INT AS timeout, (max(page_id) % 7)::INT AS max_depth, 3 AS retries,
        max(url) || ' action=' AS patterns FROM pages""",
    "media_inventory": "SELECT * FROM files",
    "output_inventory": "SELECT * FROM everything",
    # URL functions
    "default_scheme": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS full_url FROM pages""",
    "host_names": f"SELECT page_id, {host('url')} AS host, {host('url')} AS noisy_host FROM pages",
    "reference_filter": f"SELECT page_id, raw, {navigable('raw')} AS navigable, {has('abs_url', '^(?i)https?:')} AS http FROM refs",
    "resolved_links": "SELECT page_id, raw, abs_url FROM refs",
    "stripped_urls": "SELECT page_id, split_part(url, '#', 1) AS no_fragment, split_part(url, '?', 1) AS no_query FROM pages",
    "pattern_rejects": f"SELECT page_id, raw, {has('abs_url', PATTERNS)} AS rejected FROM refs",
    "domain_rejects": f"SELECT page_id, raw, contains({host('abs_url')}, 'analytics.') OR contains({host('abs_url')}, 'matomo.') AS rejected FROM refs",
    "same_host": f"SELECT page_id, raw, {host('abs_url')} = target_domain AS internal FROM refs",
    "reject_reasons": f"""SELECT target_domain, CASE WHEN NOT {navigable('abs_url')} THEN 'prefix' WHEN NOT {has('abs_url', '^(?i)https?:')} THEN 'scheme'
        WHEN {host('abs_url')} <> target_domain THEN 'host' WHEN {has('abs_url', PATTERNS)} THEN 'pattern'
        WHEN regexp_matches({host('abs_url')}, 'analytics[.]|matomo[.]') THEN 'domain' ELSE 'kept' END AS reason, count(*) AS refs FROM refs GROUP BY ALL""",
    "file_paths": f"""SELECT url, f AS file_path, {save_path('f')} AS save_path, length(f) - length(replace(f, '/', '')) AS depth FROM (
        SELECT url, {file_path('url')} AS f FROM (SELECT url FROM pages UNION ALL SELECT url FROM site))""",
    "relative_paths": f"""SELECT page_id, {relative('path', "'s'")} AS from_sheets, {relative('path', "(path || '/d/e')")} AS from_below,
        {rx('path', '[^/]*$')} AS from_itself FROM site""",
    "media_urls": f"SELECT page_id, raw, {is_media('abs_url')} AS media FROM refs",
    "base_names": f"SELECT page_id, raw, {basename('abs_url')} AS basename FROM refs",
    "decoded_attributes": "SELECT page_id, pos, raw FROM attrs WHERE tag = 'a'",
    # rules
    "range_values": "SELECT page_id, unnest(v)::VARCHAR AS value FROM ranged",
    "range_checks": "SELECT page_id, v IS NOT NULL AS valid FROM blocks LEFT JOIN ranged USING (page_id)",
    "expanded_patterns": """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p, o) - 1 AS n, 'f=' || t || '&p=' || p || '&' AS pattern FROM (
        SELECT page_id, t, o, unnest(range(1, page_id % 3 + 2)) AS p FROM (
          SELECT page_id, unnest(list_transform(v, lambda g: g::VARCHAR)) AS t, generate_subscripts(v, 1) AS o FROM ranged
          UNION ALL SELECT page_id, '{' || block || '}', 1 FROM blocks WHERE page_id NOT IN (SELECT page_id FROM ranged)))""",
    "rule_lists": """SELECT page_id, generate_subscripts(e, 1) - 1 AS n, unnest(e) AS entry FROM (
        SELECT page_id, [trim(url), 'a=b', target_domain] AS e FROM raw)""",
    "merged_settings": """SELECT target_domain, 8 AS parallel_downloads, (count(*) % 5)::INT AS max_depth, 0.0::DOUBLE AS wait_between_requests,
        'action=|' || max(url) || '|f=1&|f=2&|f=3&|Special:' AS reject_patterns FROM site GROUP BY ALL""",
    "whole_url_rejects": f"SELECT page_id, raw, {has('abs_url', PATTERNS + '|analytics.|matomo.')} AS rejected FROM refs",
    # extraction
    "navigation_links": "SELECT page_id, pos, tag, attr, raw, norm_url FROM links WHERE tag = 'a'",
    "resource_links": "SELECT page_id, pos, tag, attr, raw, norm_url FROM links WHERE tag <> 'a'",
    "internal_link_set": "SELECT DISTINCT page_id, target_domain, norm_url FROM raw_links",
    "links_per_host": """SELECT target_domain, count(DISTINCT norm_url) AS urls, count(*)::BIGINT AS links FROM (
        SELECT DISTINCT page_id, target_domain, norm_url FROM raw_links) GROUP BY ALL""",
    "html_edges": "SELECT DISTINCT target_domain, url AS src_url, norm_url AS dst_url FROM links",
    "css_imports": "SELECT * FROM css_edges",
    "html_media": media_of("media_attrs"),
    "css_media": media_of("css_values"),
    "external_media": "SELECT * FROM media",
    "scan_counters": f"""SELECT target_domain, sum(h)::BIGINT AS html_urls, sum(1 - h)::BIGINT AS css_urls,
        count(DISTINCT CASE WHEN regexp_matches(raw, '^https?://') AND {host('raw')} <> target_domain AND {is_media('raw')}
          THEN {sub('raw', '[?].*$', '')} END) AS unique_media
        FROM (SELECT target_domain, raw, 1 AS h FROM media_attrs UNION ALL SELECT target_domain, raw, 0 FROM css_values) GROUP BY ALL""",
    "page_addresses": "SELECT page_id, 'https://' || target_domain || '/' || path AS address FROM site",
    # crawl graph
    "reachable_within": "SELECT *, depth <= 4 AS processed FROM reached WHERE depth <= 5",
    "reachable_all": "SELECT * FROM reached",
    "crawl_edges": "SELECT * FROM edges",
    "edges_of_available": """SELECT e.* FROM edges e SEMI JOIN (SELECT target_domain, url FROM site WHERE page_id % 10 <> 7) a
        ON a.target_domain = e.target_domain AND a.url = e.src_url""",
    "crawl_stats": """SELECT target_domain, status, count(*) AS urls FROM status GROUP BY GROUPING SETS ((target_domain, status), (status))""",
    "resume_list": "SELECT target_domain, url, depth, path FROM status WHERE status = 'missing'",
    "politeness_schedule": """SELECT target_domain, url, depth,
        3000 * (row_number() OVER (PARTITION BY target_domain ORDER BY depth, url) - 1) AS start_ms FROM status WHERE status = 'missing'""",
    "crawl_figures": """SELECT target_domain, count(*) AS visited, count(*) FILTER (depth <= 4 AND status = 'present') AS cached,
        count(*) FILTER (status = 'missing' AND length(url) % 5 <> 0 AND length(url) % 6 = 0) AS downloaded,
        count(*) FILTER (status = 'missing' AND length(url) % 5 <> 0 AND length(url) % 6 <> 0) AS failed
        FROM (SELECT * FROM reached WHERE depth <= 5) LEFT JOIN (SELECT target_domain, url, status FROM status) USING (target_domain, url) GROUP BY ALL""",
    "resume_plan": f"""SELECT target_domain, url, depth, path FROM (SELECT *, {local('url')} AS path FROM (
        SELECT target_domain, url, min(depth) AS depth FROM walk GROUP BY ALL)) ANTI JOIN stored USING (target_domain, path)""",
    "download_batches": "SELECT *, ntile(4) OVER (PARTITION BY target_domain ORDER BY url) AS batch FROM media",
    # link rewriting
    "url_map": "SELECT target_domain, url, filename, shared FROM url_map",
    "relinked_external": "SELECT page_id, p.new_html, p.new_html <> html AS changed FROM ext_pages p JOIN site USING (page_id)",
    "without_cors": spliced("site", "items", cors_free("i.item")),
    "relinked_internal": "SELECT page_id, p.new_html, p.new_html <> html AS changed FROM int_pages p JOIN site USING (page_id)",
    "relinked_pages": "SELECT page_id, p.new_html, p.new_html <> html AS changed FROM all_pages p JOIN site USING (page_id)",
    "modified_pages": """SELECT target_domain, count(*) FILTER (p.new_html <> html) AS modified, count(*) AS pages
        FROM int_pages p JOIN site USING (page_id) GROUP BY ALL""",
    # stylesheets
    "inlined_stylesheets": "SELECT * FROM inlined",
    "google_fonts": "SELECT target_domain, path, text AS new_css FROM css_fonts",
    "localized_stylesheets": localized("css", "sheets"),
    "neutral_stylesheets": f"SELECT target_domain, path, {neutral('css')} AS new_css FROM sheets",
    "relative_stylesheets": f"SELECT target_domain, path, {rebased('css', 'path')} AS new_css FROM sheets",
    "rewritten_stylesheets": f"SELECT target_domain, path, new_css, {STEPS_APPLIED} AS steps_applied FROM ({REWRITTEN})",
    "stylesheet_counts": f"""SELECT target_domain, count(*) FILTER ({STEPS_APPLIED} > 0) AS modified, sum(n_inlined)::BIGINT AS imports_inlined,
        count(*) FILTER (contains(new_css, 'Google Fonts @import stripped')) AS fonts_stripped,
        count(*) FILTER (contains(new_css, 'External URL stripped for offline use')) AS urls_stripped FROM ({REWRITTEN}) GROUP BY ALL""",
    # offline cleaning
    "removal_candidates": f"""SELECT page_id, rule_no, item AS element FROM (SELECT page_id, item, {FIRST_RULE} AS rule_no FROM (
          SELECT *, {rx('item', '(?is)^<script[^>]*>(.*)</script', 1)} AS body FROM tags)) WHERE rule_no IS NOT NULL
        UNION ALL SELECT page_id, 10, x FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(NOSCRIPT)})) AS x FROM site) WHERE {has('x', PIXEL)}
        UNION ALL SELECT page_id, 16, x FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(FORUM_LINK)})) AS x FROM site) WHERE {has('x', FORUM)}""",
    "removed_elements": "SELECT page_id, new_html, removed FROM cleaned",
    "fallback_style": f"SELECT page_id, {styled('html')} AS new_html FROM site",
    "cleaned_scripts": f"SELECT page_id, {scripts_cleaned('html')} AS new_html FROM site",
    "cleaned_pages": f"""SELECT page_id, n AS new_html, removed, removed > 0 OR n <> html AS changed FROM (
        SELECT page_id, removed, {scripts_cleaned(styled('new_html'))} AS n FROM cleaned) JOIN site USING (page_id)""",
    "cleaned_counts": f"""SELECT target_domain, count(*) FILTER (removed > 0 OR n <> html) AS modified, sum(removed)::BIGINT AS removed FROM (
        SELECT page_id, removed, {scripts_cleaned(styled('new_html'))} AS n FROM cleaned) JOIN site USING (page_id) GROUP BY ALL""",
    # validation
    "page_checks": "SELECT page_id, missing_head, missing_body, empty_body, has_binary_content, valid FROM checked",
    "raw_page_checks": f"SELECT page_id, missing_head, missing_body, empty_body, has_binary_content, valid FROM ({checks_of('pages')})",
    "site_verdict": """SELECT target_domain, count(*) FILTER (missing_head) AS missing_head, count(*) FILTER (missing_body) AS missing_body,
        count(*) FILTER (empty_body) AS empty_body, count(*) FILTER (has_binary_content) AS has_binary_content, bool_and(valid) AS all_valid
        FROM checked GROUP BY ALL""",
    "issue_files": "SELECT * FROM issues",
    "issue_preview": """SELECT *, greatest(files - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY target_domain, issue ORDER BY path) AS rank,
        count(*) OVER (PARTITION BY target_domain, issue) AS files FROM issues) WHERE rank <= 5""",
    # guarded rewriting
    "guarded_rewrite": """SELECT page_id, replace(t2, '&copy;', '(c)') AS new_text,
        (c1 <> html AND NOT regexp_matches(html, '(?i)</head\\s*>'))::INT + (t2 <> html)::INT + (contains(t2, '&copy;'))::INT AS steps_applied FROM steps""",
    "rewrite_failures": """SELECT page_id, 'drop head end' AS step, 'HTML validation failed: missing </head>' AS error, c1 AS content FROM steps WHERE c1 <> html
        UNION ALL SELECT page_id, 'drop body', e3, c3 FROM steps WHERE c3 <> t2""",
    "guarded_stylesheets": f"""SELECT target_domain, path, t AS new_text, (t <> css)::INT AS steps_applied, (t <> '')::INT AS failed FROM (
        SELECT *, {sub('css', r'h[1-4]\{[^}]*\}', '')} AS t FROM sheets)""",
    "user_function_step": f"""SELECT page_id, {sub('spaced', ' {2,}', ' ')} AS new_text, ({sub('spaced', ' {2,}', ' ')} <> spaced)::INT AS steps_applied
        FROM (SELECT page_id, replace(html, '. ', '.   ') AS spaced FROM site)""",
    # report
    "site_totals": """SELECT *, CASE WHEN bytes >= 1073741824 THEN printf('%.2f GB', bytes / 1073741824) WHEN bytes >= 1048576 THEN printf('%.2f MB', bytes / 1048576)
        WHEN bytes >= 1024 THEN printf('%.2f KB', bytes / 1024) ELSE bytes || ' bytes' END AS size FROM (
        SELECT target_domain, count(*) AS files, sum(length)::BIGINT AS bytes, coalesce(any_value(f.failed), 0) AS failed FROM everything
        LEFT JOIN (SELECT target_domain, count(*) AS failed FROM fetch_log WHERE status <> 0 GROUP BY ALL) f USING (target_domain) GROUP BY ALL)""",
    "failed_urls": "SELECT target_domain, url FROM fetch_log WHERE status <> 0",
    "site_durations": "SELECT target_domain, (max(page_id) - min(page_id)) * 60 AS seconds FROM site GROUP BY ALL",
    # streams: the batch results
    "stream_page_verdicts": "SELECT * FROM issues",
    "stream_missing_urls": f"""SELECT target_domain, url, path FROM (SELECT DISTINCT target_domain, norm_url AS url, {local('norm_url')} AS path FROM links)
        ANTI JOIN stored USING (target_domain, path)""",
    "stream_issue_counts": """SELECT w AS window_start, issue, count(*) AS pages FROM (
        SELECT time_bucket(INTERVAL 10 minutes, make_timestamp(1704067200000000 + page_id * 60000000)) AS w, issue FROM (
          UNPIVOT (SELECT page_id, missing_head, missing_body, empty_body, has_binary_content FROM checked)
          ON missing_head, missing_body, empty_body, has_binary_content INTO NAME issue VALUE hit) WHERE hit) GROUP BY ALL""",
}
RAW_FINALS["cached_urls"], RAW_FINALS["missing_urls"] = (
    f"""SELECT target_domain, path, url FROM (SELECT *, {local('url')} AS path FROM (SELECT DISTINCT target_domain, dst_url AS url FROM edges))
        {how} JOIN stored USING (target_domain, path)"""
    for how in ("SEMI", "ANTI")
)
# whole plans
RAW_FINALS["mirrored_totals"] = RAW_FINALS["site_totals"]

ORACLES: dict[str, str] = {name: sql(final) for name, final in RAW_FINALS.items()}
ORACLES["rule_table_rejects"] = with_parts(f"""WITH rule_table AS MATERIALIZED ({RULES.replace('{each}', 'unnest(range(0, 48))')}),
    linked AS MATERIALIZED (SELECT DISTINCT target_domain, dst_url AS url FROM edges),
    hits AS (SELECT target_domain, url, min(rule) AS rule FROM linked JOIN rule_table USING (target_domain)
      WHERE CASE kind WHEN 'pattern' THEN regexp_matches(url, text) ELSE contains({host('url')}, text) END GROUP BY ALL)
    SELECT target_domain, url, coalesce(rule, -1) AS rule FROM linked LEFT JOIN hits USING (target_domain, url)""")
ORACLES["wide_range_rejects"] = f"""SELECT page_id, url, CASE WHEN f BETWEEN 1 AND 1000000 AND f NOT IN (48271, 77) AND p <= 999 THEN 7
    WHEN f BETWEEN 1100000 AND 1500000 AND p BETWEEN 990 AND 1500 AND p % 2 = 0 THEN 9 ELSE -1 END AS rule FROM ({NUMBERED})"""
# Outermost elements by walking the tags of a page one after the other, the depth carried along.
NOSCRIPT_TAG = rf"(?is){MASKED}|<noscript[^>]*>|</noscript\s*>"
ORACLES["nested_removal"] = f"""WITH RECURSIVE nested AS MATERIALIZED ({NESTED}),
  cut AS MATERIALIZED (SELECT page_id, regexp_extract_all(html, {q(NOSCRIPT_TAG)}) AS i, string_split_regex(html, {q(NOSCRIPT_TAG)}) AS g FROM nested),
  walk AS (SELECT page_id, i, 1 AS k, 0 AS depth, 0 AS span FROM cut
    UNION ALL SELECT page_id, i, k + 1, CASE WHEN {has('i[k]', '(?i)^<noscript')} THEN depth + 1
        WHEN {has('i[k]', '(?i)^</noscript')} AND depth > 0 THEN depth - 1 ELSE depth END,
      span + CASE WHEN depth = 0 AND {has('i[k]', '(?i)^<noscript')} THEN 1 ELSE 0 END
    FROM walk WHERE k <= len(i)),
  places AS (SELECT w.page_id, w.k, coalesce(w.i[w.k], '') AS item, c.g[w.k] AS gap,
      CASE WHEN w.depth > 0 THEN w.span END AS gap_span,
      CASE WHEN w.depth > 0 OR {has('w.i[w.k]', '(?i)^<noscript')} THEN w.span + CASE WHEN w.depth = 0 THEN 1 ELSE 0 END END AS item_span
    FROM walk w JOIN cut c USING (page_id)),
  gone AS (SELECT page_id, span FROM (
      SELECT page_id, span, string_agg(part, '' ORDER BY k, o) AS t FROM (
        SELECT page_id, k, 0 AS o, gap_span AS span, gap AS part FROM places UNION ALL SELECT page_id, k, 1, item_span, item FROM places)
      WHERE span IS NOT NULL GROUP BY ALL)
    WHERE {has(sub('t', '(?is)' + MASKED, ''), PIXEL)})
  SELECT page_id, string_agg(CASE WHEN (page_id, gap_span) IN (SELECT (page_id, span) FROM gone) THEN '' ELSE gap END
      || CASE WHEN (page_id, item_span) IN (SELECT (page_id, span) FROM gone) THEN '' ELSE item END, '' ORDER BY k) AS new_html,
    (SELECT count(*) FROM gone o WHERE o.page_id = p.page_id)::INT AS removed
  FROM places p GROUP BY page_id"""
ORACLES["mirrored_pages"] = with_parts(cleaned_after("ext_pages"))
ORACLES["resumed_pages"] = with_parts(cleaned_after("all_pages"))
ORACLES["early_exit_pages"] = with_parts(cleaned_after("pages7"))
ORACLES["early_exit_stylesheets"] = sql(f"""SELECT target_domain, path, new_css, {STEPS_APPLIED} AS steps_applied
    FROM ({rewritten('map7')}) SEMI JOIN media7 USING (target_domain)
    UNION ALL SELECT target_domain, path, css, 0 FROM sheets ANTI JOIN media7 USING (target_domain)""")
