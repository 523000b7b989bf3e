"""The registered queries opN_<name> of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setloom.llm.common import read
from setloom.llm.divergence import divergence
from setloom.llm.extract import extract_text
from setloom.llm.infill import fill_in_middle, restored
from setloom.llm.language import identify_language
from setloom.llm.mixing import mix_sources
from setloom.llm.packing import pack_sequences
from setloom.llm.pieces import decode_pieces, encode_pieces
from setloom.llm.quality import score_quality
from setloom.llm.simhash import fingerprint_hex, simhash_groups
from setloom.llm.suffix_dedup import remove_repeats
from setloom.llm.vectors import near_vectors, top_k
from setloom.llm.warc import read_archives, resolve_revisits, write_archives

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"), length=400, keep_text=True)
    return kept.withColumnRenamed("kept_text", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read(spark, sf_dir, "pages"), least_bytes=0)
    return resolve_revisits(read_archives(archives))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), size=2048, end_id=0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents"), width=4, most=4)
    return groups.select("doc_id", fingerprint_hex(groups.fp).alias("fingerprint"), "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)
    back = restored(made.output, made.form)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    out = decode_pieces(encode_pieces(read(spark, sf_dir, "documents"), model), model)
    ids = F.array_join(out.ids.cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_warc, op3_near_vectors, op4_language, op5_packing, op6_mixing, op7_quality, op8_top_k, op9_extract, op10_simhash, op11_divergence, op12_infill, op13_pieces)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return ORACLES


#: What SQL can say of the operators' contracts.
ORACLES = {
    "op11_divergence": """
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), grp AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT row, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang FROM grp) g),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n, any_value(l.v) AS v FROM grp g JOIN langs l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(n)::BIGINT AS n FROM gn GROUP BY lang),
share AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p
    FROM gn g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), lshare AS (
    SELECT k.lang, k.term, 1 + (1000000000 * (t.cnt + 1)) // (ln.n + l.v) AS q
    FROM kept k JOIN ln USING (lang) JOIN langs l USING (lang) JOIN (SELECT lang, term, sum(n)::BIGINT AS cnt FROM c GROUP BY lang, term) t USING (lang, term)
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::BIGINT AS value
        FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
    ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
    UNION ALL
    SELECT x.lang, x.source, 'term', x.term, (((x.p - y.q) * (x.p - y.q)) // y.q)::BIGINT FROM share x JOIN lshare y USING (lang, term) WHERE x.cnt > 0 AND x.p > y.q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
""",
    "op12_infill": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
    SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM t
), c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
f AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM f
""",
    "op8_top_k": """
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT rid AS qrid, vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (
    SELECT qrid, query_id, vec_id, list_sum(list_transform(list_zip(qe, e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM q JOIN v ON v.rid <> q.qrid AND len(e) = len(qe)
), r AS (SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
