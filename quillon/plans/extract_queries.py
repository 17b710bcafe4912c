"""Extraction from pages, and scalar functions on columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import intervals as I
from quillon.functions import text as T
from quillon.operators.saved import spread
from quillon.plans.registry import Tables, query
from quillon.sources import pages as S


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links FROM pages""")
def q_html_title(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


_NAMED = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39))"


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(" + _NAMED.format(r"regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)>', '', 'g'), '(?s)<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'), ' ([.,;:!?])', '\1', 'g')) AS shown FROM pages")
def q_visible_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.visible_text(F.col("html")).alias("shown"))


@query("SELECT p_partkey, 'a' || chr(60 + p_size) || 'b' || chr(97 + p_size % 26) || '😀 < x, y! &#99999999; &#123456789012345678901234567890; &#x; &#12 0' AS shown FROM part")
def q_character_references(t: Tables) -> DataFrame:
    """Decimal and hexadecimal references, one that a decoded ampersand begins, numbers of no character, unfinished ones."""
    hexed = F.hex((97 + F.col("p_size") % 26).cast("long"))
    page = F.format_string("<script>no</script>a&#%d;b&#X%s;&#x1F600; &amp;lt;<br> x , y ! &#99999999; &#123456789012345678901234567890; &#x; &#12 &#x000000000030;", 60 + F.col("p_size"), hexed)
    return t.part.select("p_partkey", T.visible_text(page).alias("shown"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, 'class="ad"[^>]*>([^<]*)<', 1), '~') AS titles FROM pages""")
def q_class_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(S.titles(F.col("html"), "ad"), "~").alias("titles"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)class="ad">(.*?)</div>', 1), '~') AS inner_html FROM pages""")
def q_class_elements(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(S.class_elements("ad")("html"), "~").alias("inner_html"))


@query("SELECT p_partkey, 2::BIGINT AS n, 'x<div class=\"c\">' || p_name || '</div>' AS first_one FROM part")
def q_nested_elements(t: Tables) -> DataFrame:
    """An element of the class within one of the class is no match of its own; names that only begin alike are none."""
    page = F.concat(F.lit('<div class="a c">x<div class="c">'), "p_name", F.lit('</div></div><p class="c-x">no</p><div class="c">z</div>'))
    return t.part.select("p_partkey", S.class_elements("c")(page).alias("e")).select("p_partkey", F.size("e").cast("long").alias("n"), F.get("e", 0).alias("first_one"))


def card_pages(t: Tables) -> DataFrame:
    """A page of two rendered cards for each part, in the shape that list pages have, and one item that is no card."""
    size = F.col("p_size")
    upgrade = F.when(size % 3 == 0, "").when(size % 3 == 1, '<div class="upgrade-line"><span class="upgrade-label">Blossom Upgrade:</span><p>gain <b>more</b>.</p></div>').otherwise('<span class="upgrade-label">Blossom Upgrade:</span> of old <p>gain much</p>')
    prismatic = F.when(size % 4 == 0, '<div class="upgrade-line">Prismatic Blossom : gain all </div>').otherwise("")
    often = F.when(size % 2 == 0, "Once per game. Reoffered after 3 shops").otherwise("often")
    one = F.format_string('<li data-category="%s"><div class="name-cell"><img class="icon"><strong>%s</strong> new</div><div class="cost-cell">cost <strong>%d</strong></div><div class="description-cell"><p class="description"><span>gain &amp; </span><br>lose .</p>%s%s<p class="hint">Requirements: level %d</p><p class="hint">%s</p></div><div class="stage-cell">9-9 to 9-9<div class="stage-info">2-1 to 3-%d, 4-%d ~ 5-7</div></div></li>', "p_type", "p_name", size, upgrade, prismatic, size, often, 1 + size % 7, 1 + size % 5)
    plain = F.format_string('<li class="x"><img alt="Shop offer"><div class="name-cell">%s</div><div class="cost-cell">%d gold</div><div class="description-cell"><p class="description">plain</p></div><div class="stage-cell">1-1 – 1-%d</div></li>', "p_brand", size, 1 + size % 7)
    return spread(t.part).select("p_partkey", F.concat(F.lit("<ul>"), one, F.lit('<li><div class="name-cell">no card</div></li>'), plain, F.lit("</ul>")).alias("page"))


@query("""SELECT p_partkey, 0 AS position, p_name AS name, p_size::DOUBLE AS cost, 'gain & lose.' AS effect, CASE p_size % 3 WHEN 1 THEN 'gain more.' WHEN 2 THEN 'gain much' END AS blossom, CASE WHEN p_size % 4 = 0 THEN 'gain all' END AS prismatic, 'level ' || p_size AS requirements, p_type AS category, CASE WHEN p_size % 2 = 0 THEN 3 END AS cooldown, CASE WHEN p_size % 2 = 0 THEN true END AS once, '2-1 to 3-' || (1 + p_size % 7) || ', 4-' || (1 + p_size % 5) || ' to 5-7' AS windows FROM part
UNION ALL SELECT p_partkey, 2, p_brand, NULL, 'plain', NULL, NULL, '', 'Shop', NULL, NULL, '1-1 to 1-' || (1 + p_size % 7) FROM part""")
def q_rendered_cards(t: Tables) -> DataFrame:
    rows = S.card_rows(card_pages(t), "p_partkey", "page")
    return rows.select("p_partkey", "position", "name", "cost", "effect", "blossom", "prismatic", F.array_join("requirements", ",").alias("requirements"), "category", "cooldown", "once", I.stage_text(F.col("ranges")).alias("windows"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'September ' || p_size || ', 2026' WHEN p_size % 3 = 1 THEN '2026-' || (1 + p_size % 12) || '-' || p_size END AS updated, CASE WHEN p_size % 2 = 0 THEN p_size END AS declared, sha256(page) AS sha256 FROM (SELECT *, '<p>' || CASE p_size % 3 WHEN 0 THEN 'Updated: September ' || p_size || ', 2026' WHEN 1 THEN '更新日期：2026-' || (1 + p_size % 12) || '-' || p_size ELSE 'never' END || '</p>' || CASE WHEN p_size % 2 = 0 THEN '全部 ' || p_size || ' 个' ELSE 'some' END AS page FROM part)")
def q_page_facts(t: Tables) -> DataFrame:
    """When a page was updated, how many records it declares, and its digest."""
    size = F.col("p_size")
    when = F.when(size % 3 == 0, F.format_string("Updated: September %d, 2026", size)).when(size % 3 == 1, F.format_string("更新日期：2026-%d-%d", 1 + size % 12, size)).otherwise("never")
    page = F.concat(F.lit("<p>"), when, F.lit("</p>"), F.when(size % 2 == 0, F.format_string("全部 %d 个", size)).otherwise("some"))
    return S.page_facts(t.part.select("p_partkey", page.alias("page")), "p_partkey", "page", r"全部\s*(\d+)").select("p_partkey", "updated", "declared", "sha256")


@query("SELECT o_orderkey, 'repeated_name' AS problem FROM (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) > count(DISTINCT l_returnflag)) UNION ALL SELECT o_orderkey, 'no_records' FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_repeated_names(t: Tables) -> DataFrame:
    """Pages with a record twice under one name, whatever its case, are refused."""
    pages = t.orders.select("o_orderkey", F.lit('<link rel="canonical" href="http://orders.example/">').alias("page"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    return S.import_problems(pages, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), name.alias("name")), "o_orderkey", "page", "^http://orders[.]example/", name="name")


@query("SELECT p_partkey, problem FROM part, (SELECT unnest(['wrong_identity', 'no_records', 'undeclared', 'count_mismatch']) AS problem) WHERE CASE problem WHEN 'wrong_identity' THEN p_size % 5 = 0 WHEN 'no_records' THEN p_size % 3 = 0 WHEN 'undeclared' THEN p_size % 4 = 0 ELSE p_size % 4 <> 0 AND (CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END) <> p_size % 4 END")
def q_import_problems(t: Tables) -> DataFrame:
    size = F.col("p_size")
    where = F.when(size % 5 == 0, "http://else.example/").when(size % 2 == 0, '').otherwise("")
    head = F.when(size % 5 == 0, '<link rel="canonical" href="http://else.example/x">').when(size % 2 == 0, '<meta property="og:url" content="http://parts.example/list">').otherwise('<link rel="canonical" href="http://parts.example/list">')
    said = F.when(size % 4 != 0, F.format_string("All %d items", size % 4)).otherwise("some items")
    pages = t.part.select("p_partkey", F.concat(head, said, where).alias("page"))
    return S.import_problems(pages, t.part.where("p_size % 3 <> 0"), "p_partkey", "page", "^http://parts[.]example/", r"All (\d+) items")


PAYLOAD = """concat('<script type="application/json">{"items": [{"name": "n', event_id, '", "cost": ', user_id, ', "desc": "', event_type, '"}, {"other": 1}], "more": ', props, '}</script>')"""


def payload_pages(t: Tables) -> DataFrame:
    """Pages that embed each event as JSON."""
    page = F.format_string('<script type="application/json">{"items": [{"name": "n%d", "cost": %d, "desc": "%s"}, {"other": 1}], "more": %s}</script>', "event_id", "user_id", "event_type", "props")
    return t.events.select("event_id", page.alias("page"))


@query("SELECT event_id, 4::BIGINT AS objects, 'n' || event_id AS name, event_type AS effect, user_id::DOUBLE AS cost FROM events")
def q_json_payloads(t: Tables) -> DataFrame:
    found = payload_pages(t).select("event_id", S.embedded_records(F.col("page")).alias("f"))
    return found.select("event_id", F.col("f.objects").alias("objects"), F.inline("f.records")).select("event_id", "objects", "name", "effect", "cost")


@query("SELECT event_id, '{\"k\": ' || CAST(json_extract_string(props, '$.k') AS INT) || '}' AS found FROM events")
def q_marked_object(t: Tables) -> DataFrame:
    escaped = F.concat(F.lit('x {\\"a\\": 1} '), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit(" y"))
    return t.events.select("event_id", S.marked_object(escaped, '\\\\"k\\\\"').alias("found"))


@query("SELECT p_name, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_type <> 'PROMO', p_partkey) AS n FROM part) WHERE n = 1")
def q_dedupe_locale(t: Tables) -> DataFrame:
    return S.dedupe(t.part.select("p_name", "p_partkey", "p_type"), F.col("p_name"), F.col("p_type") == "PROMO", "p_partkey")


@query("SELECT p_partkey, 2 + p_size % 5 AS s1, 1 + p_size % 7 AS r1, 8 AS s2, 7 AS r2 FROM part UNION ALL SELECT p_partkey, 9, p_size, 10, 1 FROM part")
def q_stage_labels(t: Tables) -> DataFrame:
    label = F.format_string("windows: %d-%d ~ 8-7, 9-%d ~ 10-1", 2 + F.col("p_size") % 5, 1 + F.col("p_size") % 7, "p_size")
    ranges = I.stage_ranges(label, "windows:")
    return t.part.select("p_partkey", F.explode(ranges).alias("x")).select("p_partkey", F.col("x.start.stage").alias("s1"), F.col("x.start.round").alias("r1"), F.col("x.end.stage").alias("s2"), F.col("x.end.round").alias("r2"))


@query("SELECT p_partkey, (2 + p_size % 5) || '-' || (1 + p_size % 7) || ' to 8-7' AS shown FROM part")
def q_stage_text(t: Tables) -> DataFrame:
    label = F.format_string("%d-%d ~ 8-7", 2 + F.col("p_size") % 5, 1 + F.col("p_size") % 7)
    return t.part.select("p_partkey", I.stage_text(I.stage_ranges(label)).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'snapshot_' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '_' || replace(p_name, ' ', '_') ELSE lower(replace(p_brand, '#', '_')) END AS id FROM part")
def q_derived_id(t: Tables) -> DataFrame:
    own = F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", T.derived_id(own, F.col("p_partkey") % 1000, F.col("p_name")).alias("id"))


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'prismatic' ELSE 'base' END AS kind, CASE WHEN p_type <> 'PROMO' THEN replace(p_name, ' ', '') END AS key FROM part")
def q_client_key(t: Tables) -> DataFrame:
    api = F.concat(F.lit("DA_18_"), "p_name", F.when(F.col("p_type") == "PROMO", "_Prismatic").otherwise("18"))
    return t.part.select("p_partkey", T.variant_kind(api).alias("kind"), T.client_key(api).alias("key"))


@query("SELECT doc_id, substr(sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))), 1, 16) AS key FROM documents")
def q_stable_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.stable_key(F.col("text")).alias("key"))


@query("SELECT p_partkey, lpad(lower(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296))), 8, '0') AS fingerprint FROM part")
def q_fingerprint(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.fnv1a(F.col("p_name")).alias("fingerprint"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN printf('%.2f', p_size / 10.0) ELSE printf('%.1f', p_size / 10.0) END || '%' AS shown FROM part")
def q_percent_format(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.percent(F.col("p_size") / 1000).alias("shown"))


@query("SELECT p_partkey, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, -0.5 FROM part")
def q_percentages(t: Tables) -> DataFrame:
    text = F.concat(F.lit("gain "), F.col("p_size").cast("string"), F.lit(" % then -0.5% and 7 more"))
    return t.part.select("p_partkey", F.explode(T.percentages(text)).alias("value"))


@query("SELECT p_partkey, 'Size' AS name, p_size::DOUBLE AS display, 'number' AS unit FROM part UNION ALL SELECT p_partkey, 'Price', round(p_retailprice * 100, 6), 'percent' FROM part")
def q_placeholders(t: Tables) -> DataFrame:
    values = F.create_map(F.lit("Size"), F.col("p_size").cast("double"), F.lit("Price"), F.col("p_retailprice"))
    return t.part.select("p_partkey", F.inline(T.placeholders(F.lit("adds @Size@ and @Price*100@, not @Missing@"), values)))


@query("SELECT p_partkey, '{\"a\":{\"c\":[1,{\"x\":null,\"y\":' || p_size || '}],\"d\":\"' || p_type || '\"},\"b\":\"' || p_name || '\"}' AS json FROM part")
def q_canonical_json(t: Tables) -> DataFrame:
    """Keys are sorted at every depth, also of objects within arrays."""
    text = F.format_string('{"b": "%s", "a": {"d": "%s", "c": [1, {"y": %d, "x": null}]}}', "p_name", "p_type", "p_size")
    return t.part.select("p_partkey", T.canonical_json(text).alias("json"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'more ' || p_name END AS second FROM part")
def q_distinct_second(t: Tables) -> DataFrame:
    second = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<b>more</b> "), "p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("<i>"), "p_name", F.lit("</i>")))
    return t.part.select("p_partkey", T.distinct_second(F.col("p_name"), second).alias("second"))


@query("SELECT p_partkey, p_name || ' of ' || p_type AS plain FROM part")
def q_strip_tags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.strip_tags(F.concat(F.lit(" <p class='x'>"), "p_name", F.lit("</p> of <br/>"), "p_type", F.lit(" "))).alias("plain"))


@query("SELECT doc_id, regexp_replace(lower(source || '-É ' || lang), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM documents")
def q_review_key(t: Tables) -> DataFrame:
    """Full-width letters come to plain ones; accents stay."""
    text = F.concat(F.translate("source", "src", "ｓｒｃ"), F.lit("-E\u0301 "), "lang")
    return t.documents.select("doc_id", T.review_key(text).alias("key"))


@query("SELECT doc_id, length(text) AS units FROM documents")
def q_utf16_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.utf16_length(F.col("text")).cast("long").alias("units"))


@query("SELECT p_partkey, 'structured-' || substr(sha256('type=size|operator=>=|value=' || p_size), 1, 16) AS key FROM part")
def q_proposition_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.proposition_key(F.lit("size"), F.lit(">="), F.col("p_size").cast("string"), F.col("p_name")).alias("key"))


@query("SELECT page_id, html = '' AS blank, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def q_escape_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", (F.col("html") == "").alias("blank"), T.escape_html(F.col("url")).alias("escaped"))


@query("SELECT count(*) AS pages, count(*) FILTER (html <> '') AS with_html, count(*) FILTER (contains(html, '<article>')) AS with_article FROM pages")
def q_snapshot_coverage(t: Tables) -> DataFrame:
    from quillon.operators.audit import coverage, non_empty

    return coverage(t.pages, with_html=non_empty("html"), with_article=F.col("html").contains("<article>")).withColumnRenamed("rows", "pages")
