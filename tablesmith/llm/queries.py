"""The operators over whole tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import collocations, decontaminate, langid, linededup, manifest, mixing, neardup, quality, secrets, suffixes, tokens, toxicity, warc
from tablesmith.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[run.__name__] = wraps(run)(lambda spark, sf_dir: run(prepare(spark), sf_dir))
    return run


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL["op1_mix_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0) AS size, coalesce(md5(text), '') AS tie,
         -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
           / CASE WHEN length(text) > 0 THEN greatest(plain * plain, 0.01) ELSE 1.0 END AS key
  FROM (SELECT *, length(regexp_replace(text, '[#*$%&|<>{{}}\[\]~^_=+!0-9]', '', 'g')) / length(text)::DOUBLE AS plain FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
             sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM s),
r AS (SELECT *, row_number() OVER q AS place, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST)),
l AS (SELECT arg_min((wanted - below) / open_weight, place) AS level FROM r WHERE (wanted - below) / open_weight <= cap / weight),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM r LEFT JOIN l ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target,
       epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT
         - sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, tie ROWS UNBOUNDED PRECEDING)::BIGINT + size)) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source"""


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


SQL["op4_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, text, coalesce(md5(text), '') AS key FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT doc_id, {_WORDS.format('text')} AS words FROM d)),
t AS (SELECT doc_id, pos, word, lead(word) OVER q AS second, lead(word, 2) OVER q AS third FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos FROM t WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, second, third) > 1),
inside AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, key, line, trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain,
                 len({_WORDS.format('line')}) AS words FROM (SELECT doc_id, source, key, unnest(string_split(text, chr(10))) AS line FROM d)),
repeated AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT key) AS docs FROM d GROUP BY source),
held AS (SELECT source, plain, count(DISTINCT key) AS holders FROM lines WHERE plain <> '' GROUP BY source, plain),
bad AS (SELECT held.source, plain FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE holders > 20 AND holders > docs * 0.05::DOUBLE),
removed AS (SELECT doc_id, sum(words)::BIGINT AS n FROM lines JOIN bad ON lines.source IS NOT DISTINCT FROM bad.source AND lines.plain = bad.plain GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(len({_WORDS.format('text')}), 0) AS n_words, coalesce(length(array_to_string({_WORDS.format('text')}, '')), 0) AS word_chars,
             coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols, coalesce(repeated.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words,
             coalesce(removed.n, 0) AS words_removed
      FROM d LEFT JOIN inside USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - words_removed >= n_words * 0.3::DOUBLE AS kept FROM m"""


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "class_id", "kept")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "place", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "secret")


@query
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("doc", "doc_id").withColumnRenamed("item", "item_id")


@query
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.new_folder(spark)
    warc.write_archive(pages, folder)
    read = warc.read_archive(spark, folder, payloads=False)
    kind = pages.schema["page_id"].dataType
    return read.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


_BITS = "('0x' || substr(sha, {0}, 5))::BIGINT"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_BITS.format(5 * k + 1)} >> {shift}) & 31)::INT + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
SQL["op8_warc_round_trip"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha AS first_sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON sha = first_sha"""


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = toxicity.remainder(F.col("doc_id"), 5) == 0
    classifier = toxicity.train(docs, labels=labels.filter(~held_out & F.col("toxic").isin(0, 1)))
    scored = toxicity.score(docs, classifier).withColumnRenamed("doc", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = toxicity.remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out & F.col("lang").isNotNull()))
    found = langid.identify(docs, model, spans=False).withColumnRenamed("doc", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.new_folder(spark)
    places = tokens.write_tokens(table(spark, sf_dir, "documents"), folder)
    return tokens.count_tokens(spark, folder).join(places, ["file", "ordinal"]).select(F.col("doc").alias("doc_id"), "n_tokens")


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept").cast("long")
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = [n_chars if name == "n_chars" else F.col(name) for name in manifest.FIELDS]
    found = manifest.manifest(docs.withColumn("claimed", manifest.digest(fields)), keep=["claimed"])
    folded = found.withColumn("folded_root", manifest.fold(F.col("claimed"), F.col("steps")))
    return folded.select(F.col("doc").alias("doc_id"), "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("steps")), 256).alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", "{0}", "text")) + ")"
#: The steps of a CRC: -1 shifts one bit out, any other value is a byte to take in.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda state, x: CASE WHEN x >= 0 THEN xor(state, x) ELSE xor(state >> 1, (state & 1) * 3988292384) END), 4294967295)"""
SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF.format('n_chars')} AS leaf, {_LEAF.format(f'(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)')} AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (SELECT 0 AS level, lang, place AS idx, leaf AS digest, n FROM p
      UNION ALL
      SELECT level + 1, lang, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY level, lang, idx // 2),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place AS idx, subroot AS digest, n FROM s
      UNION ALL
      SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2),
up AS (SELECT place, lang, 0 AS level, place AS idx, n, '' AS proof, claimed AS node FROM p
       UNION ALL
       SELECT up.place, up.lang, up.level + 1, up.idx // 2, (up.n + 1) // 2, up.proof || coalesce(t.digest, ''),
              sha256(CASE WHEN up.idx % 2 = 1 THEN coalesce(t.digest, '') ELSE '' END || up.node || CASE WHEN up.idx % 2 = 0 THEN coalesce(t.digest, '') ELSE '' END)
       FROM up LEFT JOIN t ON t.lang IS NOT DISTINCT FROM up.lang AND t.level = up.level AND t.idx = xor(up.idx, 1) WHERE up.n > 1),
top AS (SELECT up.place AS leaf_place, up.lang, s.place AS idx, 0 AS level, s.n, up.proof, up.node FROM up JOIN s ON s.lang IS NOT DISTINCT FROM up.lang WHERE up.n = 1
        UNION ALL
        SELECT top.leaf_place, top.lang, top.idx // 2, top.level + 1, (top.n + 1) // 2, top.proof || coalesce(u.digest, ''),
               sha256(CASE WHEN top.idx % 2 = 1 THEN coalesce(u.digest, '') ELSE '' END || top.node || CASE WHEN top.idx % 2 = 0 THEN coalesce(u.digest, '') ELSE '' END)
        FROM top LEFT JOIN u ON u.level = top.level AND u.idx = xor(top.idx, 1) WHERE top.n > 1),
root AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top ON top.leaf_place = p.place AND top.lang IS NOT DISTINCT FROM p.lang AND top.n = 1, root"""


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op12_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, {_KEY} AS key FROM l),
bad AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, bad.last IS NOT NULL AND bad.last <> doc_id AS gone FROM k LEFT JOIN bad USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


SQL["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
x AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
w AS (SELECT lang, id, unnest(words) AS a, generate_subscripts(words, 1) AS pos FROM x),
g AS (SELECT lang, a, a || ' ' || lead(a, 1) OVER q AS b, b || ' ' || lead(a, 2) OVER q AS c, c || ' ' || lead(a, 3) OVER q AS d, d || ' ' || lead(a, 4) OVER q AS e
      FROM w WINDOW q AS (PARTITION BY id ORDER BY pos)),
f AS MATERIALIZED (SELECT lang, a AS phrase, 1 AS m, count(*) AS f FROM g GROUP BY ALL UNION ALL SELECT lang, b, 2, count(*) FROM g WHERE b IS NOT NULL GROUP BY ALL
      UNION ALL SELECT lang, c, 3, count(*) FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, d, 4, count(*) FROM g WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
      UNION ALL SELECT lang, e, 5, count(*) FROM g WHERE e IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS words, m, f AS a FROM f WHERE m >= 2 AND f >= 100),
cut AS MATERIALIZED (SELECT c.*, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail FROM c, unnest(range(1, m)) AS q(k)),
h AS MATERIALIZED (SELECT cut.*, f.f AS l FROM cut JOIN f ON f.lang || ' ' || f.phrase = cut.lang || ' ' || head),
t AS MATERIALIZED (SELECT h.*, f.f AS r FROM h JOIN f ON f.lang || ' ' || f.phrase = h.lang || ' ' || tail),
s AS (SELECT t.lang, phrase, a, k, l, r, n.n::BIGINT AS n, ((1000 * a::HUGEINT * n.n) // (l::HUGEINT * r))::BIGINT AS score FROM t JOIN n ON t.lang = n.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT DISTINCT c.lang, array_to_string(c.words[i:i + m2 - 1], ' ') AS phrase, c.a AS longer FROM c, range(2, 5) AS r(m2), unnest(range(1, c.m - m2 + 2)) AS q(i) WHERE m2 < c.m)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
WHERE NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.lang = b.lang AND inner_.phrase = b.phrase AND 100 * longer >= 100 * b.a)
QUALIFY rank <= 2000"""
