"""One query per operator over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm import alignment, fm_index, host_rules, language_id, lattice_lm, line_dedup, lsh_forest, merkle, pieces, simhash, url_filters, warc
from flightlens.llm.common import NO_ID, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle.strip()
        return build

    return register


def doc_id():
    return F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
),
reach(x, y) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.x, CASE WHEN l.x = r.y THEN l.y ELSE l.x END FROM reach r JOIN links l ON l.x = r.y OR l.y = r.y
)
SELECT x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN sizes ON x = doc_id GROUP BY x
"""
)
def op1_lsh_forest(spark, sf_dir):
    rows = lsh_forest.linked(table(spark, sf_dir, "documents"), shingle=4)
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return rows.select(doc_id(), "n_shingles", component.alias("component_id"), "kept")


@query()
def op2_sentencepiece(spark, sf_dir):
    """Identifiers of every text, and whether they decode to it."""
    df = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    df = df.withColumn("exact", F.col("decoded").eqNullSafe(F.col("text")))
    return df.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "exact")


@query()
def op3_token_counts(spark, sf_dir):
    df = pieces.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.length("text").cast("long").alias("n_chars"), "n_tokens", "token_score")


@query()
def op4_lattice_lm(spark, sf_dir):
    scored = lattice_lm.score(table(spark, sf_dir, "documents"))
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return scored.select(doc_id(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {WHITE_SQL}), {UPPER_LOWER}) AS k FROM lines),
repeated AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT doc_id, i, line, coalesce(doc_id > first, FALSE) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
)
def op5_line_dedup(spark, sf_dir):
    df = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


@query(
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (SELECT page_id, unnest(range(32)) AS i FROM p),
chars AS (
    SELECT page_id, i, (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS d
    FROM digits JOIN p USING (page_id)
),
base32 AS (
    SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (d + 1)::INTEGER, 1), '' ORDER BY i) AS digest
    FROM chars GROUP BY page_id
),
largest AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(body) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN largest USING (h) JOIN base32 USING (page_id)
"""
)
def op6_warc(spark, sf_dir):
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WORDS_SQL = f"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def count_sql(chars: str) -> str:
    return f"length(coalesce(text, '')) - length(translate(coalesce(text, ''), {chars}, ''))"


@query(
    f"""
WITH docs AS (
    SELECT doc_id, source, {WORDS_SQL} AS w, string_split(coalesce(text, ''), chr(10)) AS l,
           length(coalesce(text, '')) - ({count_sql(WHITE_SQL)}) AS word_chars, {count_sql("'#*$%&|<>'")} AS n_symbols
    FROM documents
),
lines AS (SELECT *, list_filter(l, lambda x: length(trim(x, {WHITE_SQL})) > 0) AS full_lines FROM docs),
windows AS (SELECT doc_id, i, w[i:i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM windows JOIN twice USING (doc_id, win)) GROUP BY doc_id),
counted AS (
    SELECT doc_id, source, len(w) AS n_words, word_chars, n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
    FROM lines LEFT JOIN covered USING (doc_id)
),
failed AS (
    SELECT doc_id, source, unnest(['short', 'repeated', 'symbols', 'word_length', 'dup_lines']) AS rule,
           unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
                   word_chars < 3 * n_words OR word_chars > 12 * n_words, 2 * n_dup_lines > n_lines])::INTEGER AS f
    FROM counted
),
rates AS (SELECT source, rule, sum(f) AS f, count(*) AS n FROM failed WHERE source IS NOT NULL GROUP BY source, rule),
moments AS (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v, greatest(avg(n), 1) AS most FROM rates GROUP BY rule),
prior AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), most) ELSE most END AS k FROM moments),
hosts AS (SELECT source, max((f + m * k) / (n + k)) >= 0.75 AS bad FROM rates JOIN prior USING (rule) GROUP BY source),
own AS (SELECT doc_id, max(f) AS f, max(f) FILTER (WHERE rule IN ('short', 'repeated')) AS base FROM failed GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base = 1 AS base_failed, f = 0 AND NOT coalesce(bad, FALSE) AS kept
FROM counted JOIN own USING (doc_id) LEFT JOIN hosts USING (source)
"""
)
def op7_host_rules(spark, sf_dir):
    judged, _ = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(doc_id(), *host_rules.COUNTS, "base_failed", "kept")


@query(
    f"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
),
lengths AS (SELECT DISTINCT least(len(w), 13) AS n FROM words WHERE kind = 'b' AND len(w) > 0),
phrases AS (
    SELECT id AS item, n, array_to_string(w[i:i + n - 1], ' ') AS p
    FROM (SELECT id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)
),
places AS (
    SELECT id AS doc, i, n, array_to_string(w[i:i + n - 1], ' ') AS p
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE kind = 'd' AND len(w) >= n)
),
met AS (SELECT doc, item, i, n FROM places JOIN phrases USING (n, p)),
hit AS (SELECT doc, count(DISTINCT k) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc),
items AS (
    SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc, item::VARCHAR AS item FROM met) GROUP BY doc
)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit ON id = hit.doc LEFT JOIN items ON id = items.doc WHERE kind = 'd'
"""
)
def op8_fm_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), "contaminated")


@query()
def op9_link_graph(spark, sf_dir):
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.learn(docs.where(~F.col("held_out")))
    found = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "mixture.lang_pred", "mixture.score")


@query()
def op11_simhash_pigeonring(spark, sf_dir):
    rows = simhash.linked(table(spark, sf_dir, "documents"))
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return rows.select(doc_id(), "fingerprint", component.alias("component_id"))


@query()
def op12_pair_bitmaps(spark, sf_dir):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows, _ = alignment.scored(table(spark, sf_dir, "documents"), of_groups=digest)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def field_sql(value: str) -> str:
    return f"coalesce(concat(strlen({value}::VARCHAR), ':', {value}::VARCHAR), '-')"


WRITTEN = ", ".join(map(field_sql, ("doc_id", "source", "lang")))
# CRC-32 of the digits of doc_id, bit by bit: a byte is joined in, and eight times -1 shifts it out.
CRC_SQL = (
    "xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))]), "
    "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
)


@query(
    f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, sha256(concat({WRITTEN}, {field_sql('n_chars')}, {field_sql('text')})) AS h,
           CASE WHEN {CRC_SQL} % 7 = 0 THEN sha256(concat({WRITTEN}, {field_sql('(n_chars + 1)')}, {field_sql('text')})) END AS changed
    FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM rows),
nodes AS (
    SELECT g, 0 AS level, i, h FROM leaves
    UNION ALL
    SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM nodes) WHERE n > 1 GROUP BY g, level, i // 2
),
heights AS (SELECT g, max(level) AS height FROM nodes GROUP BY g),
subroots AS (SELECT g, height, h FROM nodes JOIN heights USING (g) WHERE level = height),
tops AS (
    SELECT 0 AS level, g AS i, h FROM subroots
    UNION ALL
    SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, i // 2
),
root AS (SELECT level AS top, h AS root FROM tops ORDER BY level DESC LIMIT 1),
steps AS (
    SELECT l.g, l.i, k, (l.i >> k) & 1 AS odd, coalesce(n.h, '') AS s
    FROM leaves l JOIN heights USING (g) CROSS JOIN LATERAL (SELECT unnest(range(height)) AS k)
    LEFT JOIN nodes n ON n.g = l.g AND n.level = k AND n.i = xor(l.i >> k, 1)
    UNION ALL
    SELECT l.g, l.i, height + k, (l.g >> k) & 1, coalesce(t.h, '')
    FROM leaves l JOIN heights USING (g) CROSS JOIN LATERAL (SELECT unnest(range(top)) AS k FROM root)
    LEFT JOIN tops t ON t.level = k AND t.i = xor(l.g >> k, 1)
),
folded AS (
    SELECT g, i, 0 AS k, coalesce(changed, h) AS h FROM leaves
    UNION ALL
    SELECT g, i, f.k + 1, sha256(CASE WHEN odd = 1 THEN s || f.h ELSE f.h || s END) FROM folded f JOIN steps USING (g, i, k)
),
proofs AS (SELECT g, i, sha256(string_agg(s, '' ORDER BY k)) AS proof FROM steps GROUP BY g, i)
SELECT doc_id, l.h AS leaf, subroots.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots USING (g) CROSS JOIN root LEFT JOIN proofs USING (g, i) JOIN folded f ON f.g = l.g AND f.i = l.i AND f.k = height + top
"""
)
def op13_merkle_manifest(spark, sf_dir):
    """Where 7 divides the CRC-32 of ``doc_id``, a reader finds one character more than was written."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    seen = F.when(tampered, merkle.one_more("n_chars")).otherwise(F.col("n_chars").cast("string"))
    made = merkle.manifest(docs, seen={"n_chars": seen})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
