"""Each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensfold.llm import byte_bpe, fingerprints, licenses, mixing, merkle, near_duplicates, nearest, packing, periodic, quality, secrets, sequences, token_files, twins
from lensfold.llm.common import shared_path, text_or_empty, written
from lensfold.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

MIX = {"cycle": (3.0, 1.0, 2.0), "share": 1.5, "max_epochs": 2.0, "seed": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.encode(text_or_empty(), ranks, public_tokenizers.PATTERN).alias("ids"))
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode("ids", ranks), 256).alias("decoded_sha256"),
    )


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.scan(text_or_empty()).alias("s"))
    spans = F.col("s")
    return found.select(
        "doc_id",
        *[secrets.counted(spans, k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.listed(spans, secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = token_files.read(spark, path)
    starts = F.broadcast(token_files.starts(rows))  # one row for each shuffle partition
    return rows.join(starts, "shard").select(
        "doc_id", (F.col("offset") + F.col("start_in_shard")).alias("start"), "n_tokens", token_files.crc32("ids").alias("ids_crc32")
    )


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sized(table(spark, sf_dir, "documents"), MIX["seed"])
    weights = mixing.cycled_weights(rows.select("source").distinct(), MIX["cycle"])
    steps = mixing.plan(rows, weights, MIX["share"], MIX["max_epochs"])
    return rows.join(steps, rows["source"].eqNullSafe(steps["source"])).select(
        "doc_id", rows["source"], "size", "source_size", "target", (F.col("size") * mixing.repeats()).alias("taken")
    )


@query("op6_shards")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = written(
        table(spark, sf_dir, "documents").select(
            "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")
        ),
        "shard-rows",
    )
    placed = packing.shards_of(rows.groupBy("group").agg(F.sum("size").alias("size")), 8)
    found = written(rows.join(placed, "group").drop("group"), "shards")
    return packing.slots(found, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(table(spark, sf_dir, "documents"))


@query("op5_nearest")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


@query(
    "op9_near_duplicates",
    sql="""
    WITH RECURSIVE t AS (
        SELECT row_number() OVER (ORDER BY text) AS t, text, min(doc_id) AS first_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w
        FROM documents WHERE text IS NOT NULL GROUP BY text),
    s AS (
        SELECT t, unnest(list_distinct(CASE
            WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
        FROM t),
    n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
    pairs AS (
        SELECT a, b FROM (SELECT x.t AS a, y.t AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.t < y.t GROUP BY 1, 2)
        JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    class AS (SELECT t.t, least(t.first_id, min(o.first_id)) AS class_id FROM t LEFT JOIN reach ON reach.a = t.t LEFT JOIN t o ON o.t = reach.b GROUP BY t.t, t.first_id)
    SELECT d.doc_id, CASE WHEN len(t.w) > 0 THEN class.class_id ELSE d.doc_id END AS class_id, coalesce(l.n, 0) AS links
    FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN class ON class.t = t.t
    LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = t.t
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.class_ids(near_duplicates.classes(table(spark, sf_dir, "documents")))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = written(docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), model.evidence().alias("evidence")), "quality-rows")
    return quality.judged(rows, quality.sites(rows), "host", "path", "evidence")


def licence_sql(templates: licenses.Templates) -> str:
    """The same scan without anchors: every line is scored."""
    idf = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in templates.idf.items())
    vectors = ", ".join(f"({i}, '{licence}', '{w}', {x!r}::DOUBLE)" for i, licence, w, x in templates.vectors)
    return f"""
    WITH idf(word, idf) AS (VALUES {idf}), vec(template, licence, word, weight) AS (VALUES {vectors}),
    f AS (SELECT doc_id, nullif(concat_ws('/', source, lang), '') AS directory, coalesce(text, '') AS text FROM documents),
    tl AS (SELECT DISTINCT text, unnest(string_split(lower(text), chr(10))) AS line FROM (SELECT DISTINCT text FROM f)),
    denied AS (SELECT DISTINCT line FROM tl WHERE regexp_matches(line, '{licenses.DENIED}')),
    w AS (SELECT line, unnest(regexp_split_to_array(line, '[^\\p{{L}}\\p{{N}}]+')) AS word FROM (SELECT DISTINCT line FROM tl ANTI JOIN denied USING (line))),
    c AS (SELECT line, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL),
    x AS (SELECT line, word, n * coalesce(idf, {templates.unseen!r}::DOUBLE) AS wt FROM c LEFT JOIN idf USING (word)),
    norms AS (SELECT line, sqrt(sum(wt * wt)) AS norm FROM x GROUP BY 1),
    s AS (SELECT line, licence, round(sum(wt * weight) / any_value(norm), 6) AS score FROM x JOIN vec USING (word) JOIN norms USING (line) GROUP BY line, template, licence),
    own AS (SELECT text, arg_min(licence, (-score, licence)) AS licence, max(score) AS score FROM tl JOIN s USING (line) WHERE score >= {licenses.THRESHOLD} GROUP BY 1),
    files AS (SELECT doc_id, directory, licence, score FROM f LEFT JOIN own USING (text)),
    anc AS (SELECT directory, i, array_to_string(string_split(directory, '/')[1:i], '/') AS a
        FROM (SELECT DISTINCT directory, unnest(range(1, len(string_split(directory, '/')) + 1)) AS i FROM f WHERE directory IS NOT NULL)),
    declared AS (SELECT a, arg_min(licence, doc_id) AS licence FROM files JOIN anc USING (directory) WHERE licence IS NOT NULL GROUP BY 1),
    passed AS (SELECT anc.directory, arg_max(licence, i) AS passed, arg_max(anc.a, i) AS place FROM anc JOIN declared USING (a) GROUP BY 1)
    SELECT doc_id, directory, licence AS own_licence, score, coalesce(licence, passed) AS licence, CASE WHEN licence IS NULL THEN place END AS inherited_from
    FROM files LEFT JOIN passed USING (directory)
    """


@query("op7_licenses", sql=licence_sql(licenses.Templates()))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no file names: they lie in ``source/lang``, and the licence file of a directory is its first document
    (by doc_id, also in directories below) that has a notice."""
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    own = written(licenses.notices(docs, "digest", "text", licenses.Templates()), "licence-own")
    files = docs.select("doc_id", "digest", F.nullif(F.concat_ws("/", "source", "lang"), F.lit("")).alias("directory"))
    files = written(files.join(own, "digest", "left").drop("digest"), "licence-files")
    with_notice = files.where("licence is not null and doc_id is not null").select("doc_id", "licence", F.explode(licenses.ancestors(F.col("directory"))).alias("directory"))
    declared = with_notice.groupBy("directory").agg(F.min(F.struct("doc_id", "licence")).alias("f")).select("directory", F.col("f.licence").alias("licence"))
    passed = written(licenses.inherited(files.select("directory"), declared), "licence-passed").select("directory", F.col("licence").alias("passed"), "inherited_from")
    has = F.col("licence").isNotNull()
    return files.join(passed, "directory", "left").select(
        "doc_id", "directory", F.col("licence").alias("own_licence"), "score", F.coalesce("licence", "passed").alias("licence"),
        F.when(~has, F.col("inherited_from")).alias("inherited_from"),
    )


@query("op11_sequences")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def id_crc32() -> Column:
    """CRC-32 of the decimal id; null without one."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


@query("op12_merkle_manifest", sql=twins.MANIFEST)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are not tampered with."""
    fields = ("doc_id", "source", "lang", "n_chars")
    altered = merkle.leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))
    rows = table(spark, sf_dir, "documents").select(
        "source", "doc_id", merkle.leaf(*fields, "text").alias("leaf"), F.when(id_crc32() % 2 == 0, altered).alias("altered")
    )
    rows = written(rows, "manifest-leaves").withColumn("now", F.coalesce("altered", "leaf"))
    found = merkle.proofs(rows, "source", "doc_id", "leaf", "now")
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op13_periodic_runs", sql=twins.PERIODIC_RUNS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is planted into rows without an id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.found(periodic.looped(F.col("text").cast("string"), id_crc32())).alias("s"))
    found = docs.select("doc_id", "s.runs", "s.collapsed").withColumn("best", periodic.most_repeated(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
