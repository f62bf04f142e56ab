"""Each operator as a query over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridprobe.llm import audit, bpe, decontaminate, hardneg, hmm, mixing, neighbours, quality, simhash, spans, toxicity, urls, warc
from gridprobe.session import scratch_path
from gridprobe.sources import tables

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


@query()
def op7_entropy_balanced_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(tables.table(spark, folder, "documents"))


def _mark(text):
    """A number that depends on a text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def dated_entries(pages: DataFrame) -> DataFrame:
    """Lists with a history, made from the hosts and addresses that the pages have."""
    start = F.lit("2024-01-01").cast("date")

    def events(patterns: DataFrame, name: str, scope: str, action: str, every: int, rest: int, gaps: list[tuple[str, int, int]]):
        chosen = patterns.withColumn("m", _mark(F.concat(F.lit(f"{name}:"), "pattern"))).filter(F.col("m") % every == rest)
        listed = F.array(*[
            F.struct(F.lit(event).alias("event"), F.date_add(start, (F.lit(first) + F.col("m") % span).cast("int")).alias("day"))
            for event, first, span in gaps
        ])
        return chosen.select(
            F.lit(name).alias("list"), F.lit(scope).alias("scope"), "pattern", F.lit(action).alias("action"),
            F.explode(listed).alias("e"),
        ).select("list", "scope", "pattern", "action", "e.day", "e.event")

    hosts = pages.select(urls.host_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    domains = hosts.select(F.substring_index("pattern", ".", -2).alias("pattern")).distinct()
    addresses = pages.select(urls.address_of(F.col("url")).alias("pattern")).filter("pattern <> ''").distinct()
    return (
        events(hosts, "adverts", "host", "block", 3, 0, [("add", 0, 120), ("remove", 130, 60), ("add", 200, 100)])
        .union(events(hosts, "trusted", "host", "allow", 4, 1, [("add", 0, 300)]))
        .union(events(domains, "malware", "host", "block", 1, 0, [("add", 100, 30), ("remove", 180, 30)]))
        .union(events(addresses, "reports", "url", "block", 8, 3, [("add", 0, 200), ("remove", 210, 100)]))
        .union(events(addresses, "appeals", "url", "allow", 16, 5, [("add", 50, 200)]))
    )


_EVENTS_SQL = "\n    UNION ALL\n    ".join(
    f"SELECT '{name}' AS list, '{scope}' AS scope, pattern, '{action}' AS action, '{event}' AS event, "
    f"DATE '2024-01-01' + CAST({first} + m % {span} AS INTEGER) AS day FROM "
    f"(SELECT pattern, CAST('0x' || substr(md5('{name}:' || pattern), 1, 8) AS BIGINT) AS m FROM {source}) WHERE m % {every} = {rest}"
    for name, scope, action, source, every, rest, gaps in [
        ("adverts", "host", "block", "hosts", 3, 0, [("add", 0, 120), ("remove", 130, 60), ("add", 200, 100)]),
        ("trusted", "host", "allow", "hosts", 4, 1, [("add", 0, 300)]),
        ("malware", "host", "block", "domains", 1, 0, [("add", 100, 30), ("remove", 180, 30)]),
        ("reports", "url", "block", "addresses", 8, 3, [("add", 0, 200), ("remove", 210, 100)]),
        ("appeals", "url", "allow", "addresses", 16, 5, [("add", 50, 200)]),
    ]
    for event, first, span in gaps
)


@query(
    rf"""
    WITH c AS (
        SELECT page_id, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
               rtrim(regexp_extract(coalesce(url, ''), '^[^:/?#]*://[^/?#]*([^#]*)', 1), '/') AS rest,
               DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day
        FROM pages
    ),
    captures AS (SELECT page_id, host, CASE WHEN host = '' THEN '' ELSE host || rest END AS address, day FROM c),
    hosts AS (SELECT DISTINCT host AS pattern FROM captures WHERE host <> ''),
    domains AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM hosts),
    addresses AS (SELECT DISTINCT address AS pattern FROM captures WHERE address <> ''),
    entries AS ({_EVENTS_SQL}),
    daily AS (
        SELECT list, scope, pattern, action, day, max(CASE WHEN event = 'remove' THEN 1 ELSE 0 END) AS removed
        FROM entries GROUP BY ALL
    ),
    changes AS (
        SELECT * FROM (SELECT *, lag(removed, 1, 1) OVER w AS before FROM daily
                       WINDOW w AS (PARTITION BY list, scope, pattern, action ORDER BY day)) WHERE removed <> before
    ),
    intervals AS (
        SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, scope, pattern, action ORDER BY day) AS ends FROM changes)
        WHERE removed = 0
    ),
    matches AS (
        SELECT c.page_id, i.list, i.pattern, i.day AS since, i.action,
               CASE WHEN i.scope = 'url' THEN 1000 ELSE len(string_split(i.pattern, '.')) END AS rank
        FROM captures c JOIN intervals i
          ON c.day >= i.day AND (i.ends IS NULL OR c.day < i.ends)
         AND ((i.scope = 'url' AND i.pattern = c.address)
              OR (i.scope = 'host' AND (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern))))
    ),
    best AS (
        SELECT *, row_number() OVER (
            PARTITION BY page_id ORDER BY rank DESC, CASE action WHEN 'block' THEN 0 ELSE 1 END, list, pattern, since) AS at
        FROM matches
    )
    SELECT p.page_id, coalesce(b.action, 'keep') AS verdict, b.list, b.pattern, b.since
    FROM captures p LEFT JOIN best b ON b.page_id = p.page_id AND b.at = 1
    """
)
def op1_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = tables.table(spark, folder, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int"))
    return urls.judged(pages.select("page_id", "url", fetched.alias("fetched")), dated_entries(pages))


@query()
def op2_simhash_trie_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(tables.table(spark, folder, "documents"))


@query()
def op3_noisy_channel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classified(tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels"))


@query(
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0),
    link AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b
        ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
    ),
    reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
    low AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x),
    degree AS (SELECT x, count(*) AS n FROM link GROUP BY x)
    SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(l.root, e.vec_id) AS component_id,
           e.vec_id = coalesce(l.root, e.vec_id) AS kept
    FROM embeddings e LEFT JOIN low l ON l.x = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id
    """
)
def op4_nn_descent_links(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(tables.table(spark, folder, "embeddings"))


@query()
def op5_line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels"))


@query()
def op6_sentence_span_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return spans.deduplicated(tables.table(spark, folder, "documents"))


@query(
    """
    WITH p AS (
        SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
               sha1(coalesce(html, '')) AS sha
        FROM pages WHERE page_id IS NOT NULL
    ),
    bits AS (
        SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha, CAST(5 * i + 1 AS INTEGER), 5) AS INTEGER)) AS q,
               min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first
        FROM p
    )
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr(
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((q[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
    FROM bits
    """
)
def op8_sharded_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    manifest = warc.write(tables.table(spark, folder, "pages"), archives)
    return warc.read(spark, archives, manifest)


@query()
def op9_simhash_window_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(
        tables.table(spark, folder, "documents"), tables.table(spark, folder, "benchmark")
    )


@query()
def op10_hidden_markov_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.scored(tables.table(spark, folder, "documents"))


@query()
def op13_chunked_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    words = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = tables.table(spark, folder, "documents").select("doc_id", "text")
    both = bpe.decoded(bpe.encoded(docs, words), words)
    return both.select(
        "row.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ),
    marks AS (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ),
    masks AS (
        SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
               CASE WHEN len(d.words) < 50 THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(d.words)) < 65 * len(d.words) THEN 2 ELSE 0 END
               + CASE WHEN 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 5 * length(d.text) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY d.text) THEN 16 ELSE 0 END AS mask
        FROM d LEFT JOIN marks m ON m.doc_id = d.doc_id
    ),
    cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
    letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
    orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
               [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ),
    steps AS (
        SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
        FROM orders, (SELECT unnest(range(1, 6)) AS step)
    ),
    counts AS (
        SELECT c.part, s.filter_order, s.step, s.own,
               sum(CASE WHEN c.mask & (s.before | s.own) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before = 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before <> 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN c.mask = s.own THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before = 0 THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before = 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM cells c, steps s GROUP BY c.part, s.filter_order, s.step, s.own
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM counts
    """
)
def op12_failing_id_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audited(tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels"))


@query(
    """
    WITH p AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ),
    positive AS (
        SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score,
                              row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same)
        WHERE place <= 5
    ),
    negative AS (
        SELECT o.anchor_id, o.positive_id, o.positive_score, s.id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY o.anchor_id, o.positive_id ORDER BY s.score DESC, s.id) AS rank
        FROM positive o JOIN s ON s.anchor_id = o.anchor_id AND NOT s.same
         AND 50 * o.positive_score <= 100 * s.score AND 100 * s.score <= 95 * o.positive_score
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM negative WHERE rank <= 3
    """
)
def op11_l2ap_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vec = F.when(
        hardneg.usable(F.col("embedding")), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    )
    points = tables.table(spark, folder, "embeddings").select("vec_id", label.alias("label"), vec.alias("vec"))
    return hardneg.mined(points, F.col("vec_id") % 50 == 0)
