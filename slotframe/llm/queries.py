"""The operators as queries over the given tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.llm import ann, decontam, fim, langid, linededup, minhash, mixing, quality, sharding, spelling, topk, urlfilter, warc
from slotframe.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40
URL_RULES = [
    urlfilter.host_rule("block", "net"),
    urlfilter.host_rule("allow", "example.net", "/en/"),
    urlfilter.host_rule("block", "example.com", "/de/"),
    urlfilter.host_rule("allow", "org", "/fr/"),
]


def query(sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


SQL_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+')"""


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({SQL_WORDS}, []) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, min(a.n) + min(b.n) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)),
    ab AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, ab.b FROM r JOIN ab ON r.reached = ab.a)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
    FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)""")
def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query()
def op4_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


@query()
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item found in it."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out("doc_id", 5, 0)
    model = langid.fit(docs.where(~out), order_by=F.col("doc_id"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages", "proportions")


@query()
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(r"""WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    m AS (SELECT h.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM h JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY h.page_id)
    SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""")
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out("doc_id", 4, 2)
    model = quality.fit(docs.where(~out).select("doc_id", "text"), labels)
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "signal")


@query()
def op1_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("""WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
        url FROM pages),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to FROM m""")
def op2_archive_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no capture time; a second for each page_id stands in for it."""
    pages = table(spark, sf_dir, "pages")
    path = warc.write_archives(pages, captured=F.timestamp_seconds(F.col("page_id") + 1_577_836_800))
    index = warc.capture_index(warc.read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i - 1 AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
    s AS (SELECT doc_id, line, list_sort(list_distinct({SQL_WORDS})) AS w FROM l),
    f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS turn FROM s WHERE len(w) > 0),
    c AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, w, len(w) AS n FROM f WHERE turn = 1),
    t AS (SELECT id, n, unnest(w) AS t FROM c),
    df AS (SELECT t, count(*) AS df FROM t GROUP BY t),
    o AS (SELECT id, n, t.t, row_number() OVER (PARTITION BY id ORDER BY df, t.t) AS place FROM t JOIN df USING (t)),
    p AS (SELECT * FROM o WHERE place <= n - (n * 80 + 99) // 100 + 1),
    m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND a.id < b.id
        AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    g AS (SELECT DISTINCT m.b AS id FROM m JOIN c x ON m.a = x.id JOIN c y ON m.b = y.id
        WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
    r AS (SELECT f.doc_id, f.line FROM f JOIN c USING (w) LEFT JOIN g ON c.id = g.id WHERE g.id IS NOT NULL OR f.turn > 1)
    SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, CAST(count(r.line) AS BIGINT) AS n_removed,
        coalesce(string_agg(CAST(r.line AS VARCHAR), ',' ORDER BY r.line), '') AS removed
    FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, len(d.ls)""")
def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_matches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""")
def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(r"""WITH RECURSIVE tab AS (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
        FROM range(0, 256) t(i)),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents),
    keys AS (SELECT doc_id, run, count(*) AS n, hex(doc_id || ':' || run) AS h FROM runs GROUP BY doc_id, run),
    crc AS (SELECT h, 1 AS pos, CAST(4294967295 AS BIGINT) AS c FROM keys
        UNION ALL SELECT h, pos + 2, xor(c >> 8, v) FROM crc JOIN tab ON pos < length(h) AND tab.i = xor(c, CAST('0x' || substr(h, pos, 2) AS BIGINT)) & 255),
    marked AS (SELECT run, n, xor(c, 4294967295) AS m FROM keys JOIN crc USING (h) WHERE pos > length(h)),
    v AS (SELECT CASE WHEN m % 97 = 0 THEN substr(run, 1, m % length(run)) || substr(run, m % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
        FROM marked GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
    d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
    near AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
        UNION SELECT d.word, v.word FROM d JOIN v ON d.d = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.d = v.word),
    best AS (SELECT near.a AS word, count(*) AS n_near, max(v.n) AS most FROM near JOIN v ON near.b = v.word GROUP BY near.a),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * v.n THEN most END AS form_n,
        CASE WHEN most >= 2 * v.n THEN (SELECT min(x.word) FROM near JOIN v x ON near.b = x.word WHERE near.a = v.word AND x.n = most) END AS form
        FROM v LEFT JOIN best USING (word)),
    way AS (SELECT word, word AS last FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.last = f.word AND f.form IS NOT NULL)
    SELECT f.word, f.form, way.last AS root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f e ON way.last = e.word AND e.form IS NULL""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    p AS (SELECT *, coalesce(array_to_string(u[:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(t) AS restored_sha256 FROM p""")
def op13_middle_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = fim.frame_texts(table(spark, sf_dir, "documents"), F.col("doc_id"))
    found = fim.digests(fim.fill_in_middle(framed, F.col("key")))
    return found.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
