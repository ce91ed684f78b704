"""Queries over text, pages and the ingest pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import url as ur
from quillspark.functions.vector import hash_embedder
from quillspark.operators import chunking, conversations, ingest
from quillspark.plans.views import table, view, with_views
from quillspark.sources import frames

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WS = r"[ \t\n\r\f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATIN = r"\p{Latin}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


SAMPLES = [
    (1, "هل التوصيل مجاني؟"), (2, "Is delivery free?"), (3, "Hi مرحبا بكم"), (4, "👍"), (5, "2024"), (6, "؟؟؟"), (7, "   "), (8, ""),
    (9, "سعر iPhone ١٥ في المتجر"), (10, "أهلاً وسهلاً"), (11, "مُحَمَّد"), (12, "مـــرحبا"), (13, "café crème"), (14, "۱۲۳"),
]
VALUES = ", ".join(f"({i}, '{t}')" for i, t in SAMPLES)
SAMPLE_SQL = f"s(id, t) AS (VALUES {VALUES}), x AS (SELECT id, t FROM s UNION ALL SELECT doc_id + 100 AS id, text AS t FROM documents)"


def _texts(s, d):
    """Arabic and mixed samples, and all documents."""
    own = s.createDataFrame(SAMPLES, "id bigint, t string")
    return own.unionByName(table(s, d, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("t")))


AR, LA = r"len(regexp_extract_all(t, '[\x{620}-\x{63f}\x{641}-\x{64a}\x{66e}\x{66f}\x{671}-\x{6d3}\x{6d5}\x{6e5}\x{6e6}\x{6ee}\x{6ef}\x{6fa}-\x{6fc}\x{6ff}\x{750}-\x{77f}]'))", r"len(regexp_extract_all(t, '[a-zA-Z\x{aa}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2b8}]'))"


@query(f"""WITH {SAMPLE_SQL}, n AS (SELECT id, {AR} AS a, {LA} AS l FROM x)
SELECT id, CASE WHEN a + l = 0 THEN 'en' WHEN a / (a + l) >= 0.2 THEN 'ar' ELSE 'en' END AS language, CASE WHEN a + l > 0 AND a / (a + l) >= 0.2 THEN 'rtl' ELSE 'ltr' END AS dir,
  round(CASE WHEN a + l = 0 THEN 0.0 ELSE a / (a + l) END, 6) AS ratio, a > 0 AND l > 0 AND a / (a + l) > 0.1 AND a / (a + l) < 0.9 AS mixed FROM n""")
def detect_language(s, d):
    found = _texts(s, d).select("id", tx.detect_language(F.col("t")).alias("x")).select("id", "x.*")
    return found.withColumn("ratio", F.round("ratio", 6))


MIXED = "CASE (conversation * 5 + turn * 3) % 7 WHEN 0 THEN 'هل التوصيل مجاني؟' WHEN 1 THEN '42' WHEN 2 THEN 'Hi مرحبا بكم' ELSE text END"


@query(f"""WITH u AS (SELECT conversation, turn, {MIXED} AS t, row_number() OVER (PARTITION BY conversation ORDER BY turn DESC) AS back FROM v_messages WHERE role = 'user'),
f AS (SELECT conversation, row_number() OVER (PARTITION BY conversation ORDER BY turn) AS i, {AR} AS a, {LA} AS l FROM u WHERE back <= 5),
w AS (SELECT conversation, sum(i * least(a + l, 200)) AS w, sum(i * least(a + l, 200) * CASE WHEN a + l = 0 THEN 0 ELSE a / (a + l)::DOUBLE END) AS s FROM f GROUP BY 1)
SELECT conversation, CASE WHEN w = 0 THEN 'en' WHEN s / w >= 0.2 THEN 'ar' ELSE 'en' END AS language FROM w""")
def conversation_language(s, d):
    """Only the last five messages of a conversation are collected."""
    back = F.expr("row_number() OVER (PARTITION BY conversation ORDER BY turn DESC)")
    said = view(s, d, "messages").where("role = 'user'").withColumns({"text": F.expr(MIXED), "back": back}).where("back <= 5")
    rows = said.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    return rows.select("conversation", tx.conversation_language(F.transform("m", lambda x: x["text"])).alias("language"))


FOLD_FROM = "".join(map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *tx.LETTER_FOLDS]))
FOLD_TO = "0123456789" * 2 + "".join(map(chr, tx.LETTER_FOLDS.values()))
MARKS = "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in tx.MARK_RANGES) + r"\x{640}]"


@query(f"WITH {SAMPLE_SQL} SELECT id, {trimmed(f'''regexp_replace(translate(regexp_replace(t, '{MARKS}', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}'), '{WS}+', ' ', 'g')''')} AS normalized FROM x")
def normalize_arabic(s, d):
    return _texts(s, d).select("id", tx.normalize_arabic(F.col("t")).alias("normalized"))


@query(rf"""WITH {SAMPLE_SQL}, n AS (SELECT id, t, {count_of('t', r'\p{Arabic}')} AS a, {count_of('t', WS)} AS w FROM x)
SELECT id, CASE WHEN {trimmed('t')} = '' THEN 0 ELSE greatest(1, CAST(floor(a / 3.34::DOUBLE + (length(t) - a - w) / 4.45::DOUBLE + 0.5::DOUBLE) AS INTEGER)) END AS tokens FROM n""")
def estimate_tokens(s, d):
    return _texts(s, d).select("id", tx.estimate_tokens(F.col("t")).alias("tokens"))


TWO = "replace(text, chr(10), chr(10) || chr(10))"


@query(f"WITH p AS (SELECT doc_id, unnest(string_split({TWO}, chr(10) || chr(10))) AS p FROM documents) SELECT doc_id, {trimmed('p')} AS paragraph FROM p WHERE {trimmed('p')} <> ''")
def paragraphs(s, d):
    docs = table(s, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return docs.select("doc_id", F.explode_outer(tx.split_paragraphs(F.col("text"))).alias("paragraph")).where("paragraph is not null")


# The other engine has no look-around: ends that count are marked first, full stops inside numbers after that
# (twice, as a single digit between two full stops belongs to both matches).
@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([!?\x{{61f}}\x{{6d4}}\n.])', '\1' || chr(1), 'g'), '(\d\.)' || chr(1) || '(\d)', '\1\2', 'g'), '(\d\.)' || chr(1) || '(\d)', '\1\2', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS p FROM m) SELECT doc_id, {trimmed('p')} AS sentence FROM p WHERE {trimmed('p')} <> ''""")
def sentences(s, d):
    return table(s, d, "documents").select("doc_id", F.explode_outer(tx.split_sentences(F.col("text"))).alias("sentence")).where("sentence is not null")


@query(f"""WITH q AS (SELECT conv_id, turn, {trimmed('text')} AS t FROM conversations WHERE {trimmed('text')} <> '')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, t AS text FROM q""")
def faq_chunks(s, d):
    pairs = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("question"), F.lit("").alias("answer")))).alias("pairs"))
    return chunking.chunk_pairs(pairs, "conv_id", "pairs").select("conv_id", F.col("position").cast("long").alias("position"), "text")


@query()
def chunk_text(s, d):
    """Chunks of every document, its lines read as paragraphs."""
    docs = table(s, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.chunk_documents(docs, "doc_id", "text")


@query()
def index_documents(s, d):
    """Chunks with normal form and embedding, ready for the index."""
    return ingest.index_documents(table(s, d, "documents"), "doc_id", "text", 64).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 5)))


@query()
def html_extract(s, d):
    return ingest.extract_pages(table(s, d, "pages")).select("page_id", "title", "text", F.size("links").alias("links"))


@query("SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages)")
def page_hosts(s, d):
    return table(s, d, "pages").select("page_id", ur.host(F.col("url")).alias("host"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, {trimmed(f"regexp_replace(line, '{WS}+', ' ', 'g')")} AS line FROM l), k AS (SELECT * FROM c WHERE line <> ''),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)
SELECT d.doc_id, coalesce((SELECT string_agg(line, chr(10) || chr(10) ORDER BY i) FROM p WHERE p.doc_id = d.doc_id AND (before IS NULL OR before <> line)), '') AS text FROM documents d""")
def tidy(s, d):
    return table(s, d, "documents").select("doc_id", tx.tidy(F.col("text")).alias("text"))


# Texts that meet each verdict: whole and reversed function words, display glyphs, undecoded letters, none at all.
WORDY = " ".join(["كتاب في بيت من حجر على جبل إلى مدينة"] * 12)
GATE = [(1, WORDY, "ok"), (2, WORDY[::-1], "display order"), (3, "كتاب بيت حجر " * 30, "no recognisable words"), (4, "\ufe8d\ufedf\ufee4 كتاب" * 40, "display glyphs"), (5, "abc \ufffd", "encoding not decoded"), (6, "123 ...", "no readable characters"), (7, "مرحبا", "ok")]
GATED = ", ".join(f"({i}, '{w}')" for i, _, w in GATE)


@query(rf"SELECT doc_id + 100 AS id, CASE WHEN {count_of('text', r'\p{L}')} = 0 THEN 'no readable characters' ELSE 'ok' END AS reason FROM documents UNION ALL SELECT * FROM (VALUES {GATED})")
def readable_gate(s, d):
    own = s.createDataFrame([(i, t) for i, t, _ in GATE], "id bigint, text string")
    rows = own.unionByName(table(s, d, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    return rows.select("id", tx.readability(F.col("text")).alias("reason"))


@query("WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a' || c_custkey || '@b.example' WHEN 1 THEN '+1 555 ' || (1000000 + c_custkey) WHEN 2 THEN 'call me' ELSE '12' END AS contact FROM customer) SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' ELSE 'other' END AS kind FROM c")
def contact_kind(s, d):
    k = F.col("c_custkey")
    t = k.cast("string")
    contact = F.when(k % 4 == 0, F.concat(F.lit("a"), t, F.lit("@b.example"))).when(k % 4 == 1, F.concat(F.lit("+1 555 "), (k + 1000000).cast("string"))).when(k % 4 == 2, "call me").otherwise("12")
    return table(s, d, "customer").select(k, tx.contact_kind(contact).alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Sales team ' || c_custkey END AS label FROM customer")
def display_name(s, d):
    t = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    return table(s, d, "customer").select("c_custkey", tx.display_name(name, F.concat(F.lit("sales.team_"), t, F.lit("+x@y.example"))).alias("label"))


RULES = "Answer only from the sources. If they do not say, reply exactly: "


@query(f"""SELECT doc_id, 'You are Assistant, the customer support assistant for ' || source || '.' || chr(10) || chr(10) || '{RULES}' || '{tx.REFUSALS['en'].replace("'", "''")}' || chr(10) || chr(10) || 'SOURCES:' || chr(10)
  || chr(10) || '[1] untitled source' || chr(10) || '    \"\"\"' || chr(10) || '    ' || replace(replace(text, '\"\"\"', ''''''''), chr(10), chr(10) || '    ') || chr(10) || '    \"\"\"' || chr(10) AS prompt FROM documents""")
def prompt_render(s, d):
    one = F.array(F.struct(F.lit("").alias("title"), F.lit("").alias("url"), F.col("text").alias("text")))
    return table(s, d, "documents").select("doc_id", tx.render_prompt(F.col("source"), F.lit("en"), one, RULES).alias("prompt"))


@query("""WITH p AS (SELECT page_id, url, lag(url) OVER (ORDER BY page_id) AS before FROM pages),
k AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS h, lower(regexp_extract(before, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS g, starts_with(lower(url), 'https') AS a, starts_with(lower(before), 'https') AS b FROM p WHERE before IS NOT NULL)
SELECT page_id, h = g AND a = b AS same FROM k""")
def same_site(s, d):
    pages = table(s, d, "pages").select("page_id", "url")
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("before"))
    return pages.join(before, "page_id").select("page_id", ur.same_site(F.col("url"), F.col("before")).alias("same"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['h', 'p', 'q']) AS u FROM pages)
SELECT page_id, lower(regexp_replace(u.h, ':\d+$', '')) || CASE WHEN regexp_replace(u.p, '/$', '') = '' THEN '/' ELSE regexp_replace(u.p, '/$', '') END || CASE WHEN length(u.q) > 1 THEN u.q ELSE '' END AS key FROM p""")
def url_keys(s, d):
    return table(s, d, "pages").select("page_id", ur.url_key(F.col("url")).alias("key"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)([^?#]*)', ['h', 'p']) AS u FROM pages)
SELECT page_id, CASE WHEN regexp_extract(u.p, '([^/]*)$', 1) = '' THEN regexp_replace(u.h, ':\d+$', '') ELSE regexp_extract(u.p, '([^/]*)$', 1) END AS title FROM p""")
def title_from_url(s, d):
    return table(s, d, "pages").select("page_id", ur.title_from_url(F.col("url")).alias("title"))


@query(r"SELECT page_id, regexp_matches(url, '(?i)\.(jpg|jpeg|png|gif|webp|svg|ico|avif|css|js|mjs|map|woff|woff2|ttf|otf|eot|zip|gz|tar|rar|7z|dmg|exe|apk|mp4|webm|mp3|wav|avi|mov|xml|rss|atom|json)$') AS asset FROM pages")
def asset_filter(s, d):
    return table(s, d, "pages").select("page_id", ur.is_asset(F.col("url")).alias("asset"))


ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nCrawl-delay: 2.5\n\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: quill\nDisallow: /*9$\nAllow: /fr\n"


@query(r"""WITH p AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM pages)
SELECT page_id, NOT (regexp_matches(p, '9$') AND instr(p, '9') = length(p)) OR starts_with(p, '/fr') AND length('/fr') >= length('/*9$') AS allowed FROM p""")
def robots_allowed(s, d):
    pages = table(s, d, "pages").withColumn("rules", ur.robots_rules(F.lit(ROBOTS), "QuillSpark/1.0")["rules"])
    return pages.select("page_id", ur.robots_allow(F.col("rules"), F.try_parse_url("url", F.lit("PATH"))).alias("allowed"))


@query("SELECT doc_id, length(text) < 120 AS thin FROM documents")
def thin_pages(s, d):
    return table(s, d, "documents").select("doc_id", ingest.is_thin(F.col("text")).alias("thin"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '') IN ('tionsh.example.net', 'm.tiontion.example.com') AS allowed FROM pages")
def origin_allowed(s, d):
    listed = F.array(F.lit("https://www.Tionsh.example.net/x"), F.lit(" m.tiontion.example.com "))
    return table(s, d, "pages").select("page_id", ur.origin_allowed(listed, F.col("url")).alias("allowed"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, event_type AS name, 'light' AS theme FROM events")
def widget_config_json(s, d):
    e = table(s, d, "events")
    shown = frames.public_widget(F.col("props"), F.col("event_type"))
    return e.select("event_id", frames.pick(frames.json_map(F.col("props")), "k", "none").alias("k"), shown["name"].alias("name"), shown["theme"].alias("theme"))


@query("SELECT event_id, event_type AS event, value FROM events")
def sse_round_trip(s, d):
    framed = table(s, d, "events").select("event_id", frames.frame(F.col("event_type"), F.struct("value")).alias("raw"))
    return frames.parse_frames(framed, "raw", "struct<value: double>").select("event_id", "event", "payload.value")


@query(r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS word FROM documents), k AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w WHERE word <> ''),
f AS (SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) % 64 AS bucket FROM k),
c AS (SELECT doc_id, bucket, count(*) AS n FROM w JOIN f ON w.word = f.word GROUP BY 1, 2), t AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM c GROUP BY 1)
SELECT c.doc_id, c.bucket, CAST(CAST(c.n AS FLOAT) / CAST(t.size AS FLOAT) AS DOUBLE) AS value FROM c JOIN t ON c.doc_id = t.doc_id""")
def hash_embed(s, d):
    """The filled buckets of every document's vector."""
    vectors = table(s, d, "documents").select("doc_id", F.posexplode(hash_embedder(64)(F.col("text"))).alias("bucket", "value"))
    return vectors.where("value <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.col("value").cast("double").alias("value"))


@query()
def crawl_bfs(s, d):
    """Pages of each host reached from its first page over the links between known pages."""
    pages = ingest.extract_pages(table(s, d, "pages"))
    links = ingest.page_links(pages, "page_id").select("src", "dst", "place")
    roots = pages.groupBy(ur.host(F.col("url")).alias("site")).agg(F.min_by("url", "page_id").alias("url"))
    robots = roots.select("site", F.lit(ROBOTS).alias("body"))
    return ingest.crawl(links, roots, robots, indexable=pages.where(~ingest.is_thin(F.col("text"))).select("url"))


@query("SELECT conversation, turn, CASE WHEN conversation % 5 IN (1, 2) THEN 'human' ELSE outcome END AS outcome, conversation % 5 NOT IN (1, 2) AND outcome = 'answered' AS metered FROM v_messages WHERE role = 'assistant'")
def reply_rows(s, d):
    rows = view(s, d, "messages").where("role = 'assistant'")
    status = F.when(F.col("conversation") % 5 == 1, "escalated").when(F.col("conversation") % 5 == 2, "human").otherwise("active")
    made = conversations.replies(rows.withColumns({"status": status, "language": F.lit("en"), "verdict": F.lit("allow")}))
    return made.select("conversation", "turn", "outcome", "metered")


@query("""WITH u AS (SELECT DISTINCT conversation FROM v_messages WHERE rating = 'up')
SELECT c.conversation, CASE WHEN u.conversation IS NOT NULL AND status = 'active' THEN 'auto_resolved' ELSE status END AS status,
  CASE WHEN u.conversation IS NOT NULL AND status = 'active' THEN 'rated_helpful' ELSE resolution_signal END AS resolution_signal FROM v_conversations c LEFT JOIN u ON c.conversation = u.conversation""")
def rating_update(s, d):
    return conversations.rate(view(s, d, "conversations"), view(s, d, "messages").select("conversation", "rating")).select("conversation", "status", "resolution_signal")
