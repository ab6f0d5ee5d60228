"""The registered queries of this subpackage; each derives its columns from an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgrove.llm import chat, exact_dedup, fingerprints, jaccard_join, language_id, lexical_search, mixing, packing, periodic_runs, pivot_search, pseudo_likelihood, secrets, substring_dedup
from depgrove.llm.common import WORD, table

#: Fixed text of the extra conversation that op4 formats.
PROBE = "\\### Assistant: </turn> ok"


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = pseudo_likelihood.word_counts(docs)
    frequent, hashed = pseudo_likelihood.WIDE
    words, network = pseudo_likelihood.fit(docs, counts=counts, frequent=frequent, hashed=hashed, kind=pseudo_likelihood.Grouped)
    return pseudo_likelihood.score(docs, words, network, counts)


def op2_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept", "spans")


def op3_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(rows.unionByName(probe)).withColumn("turns", chat.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op8_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")), **packing.REGISTERED)


def op9_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op10_combination_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the text of a document whose id's crc32 ends in 0 ends in a repeated stretch of its own words."""
    words, h = F.col("words"), F.col("h")
    g = F.floor(h / 10)
    n = F.greatest(F.size(words), F.lit(1))
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, period), (F.floor((n - a) / period) + 1).cast("int")))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = marked.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    return split.select("doc_id", F.when(F.size(words) > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_branching_tandems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pivot_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.nearest_of_each(table(spark, sf_dir, "embeddings"))


def op13_length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_block_anchors": op2_block_anchors,
    "op3_weighted_sampling": op3_weighted_sampling,
    "op4_chat_format": op4_chat_format,
    "op5_crf_secrets": op5_crf_secrets,
    "op6_cross_parsing": op6_cross_parsing,
    "op7_cube_mix": op7_cube_mix,
    "op8_vector_best_fit": op8_vector_best_fit,
    "op9_grace_dedup": op9_grace_dedup,
    "op10_combination_prefix_join": op10_combination_prefix_join,
    "op11_branching_tandems": op11_branching_tandems,
    "op12_pivot_elimination": op12_pivot_elimination,
    "op13_length_strata": op13_length_strata,
}

ORACLES: dict[str, str] = {
    "op2_block_anchors": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS key FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM s),
        g AS (SELECT DISTINCT doc_id, i + j AS pos FROM m, (SELECT unnest(range(0, 50)) AS j) WHERE first < doc_id),
        p AS (SELECT doc_id, pos, words[pos] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w)),
        k AS (SELECT p.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op10_combination_prefix_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
            UNION SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, coalesce(min(r.other), w.doc_id) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op4_chat_format": r"""
        WITH rows AS (
            SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, length('<turn role="') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + 2
                + CASE WHEN role = 'assistant' THEN length('<loss></loss>') ELSE 0 END
                + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1 AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op11_branching_tandems": r"""
        WITH RECURSIVE digits AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS said FROM documents WHERE doc_id IS NOT NULL),
        crc(doc_id, said, step, c) AS (
            SELECT doc_id, said, 0, 4294967295::BIGINT FROM digits
            UNION ALL SELECT doc_id, said, step + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
            FROM (SELECT doc_id, said, step, CASE WHEN step % 8 = 0 THEN xor(c, ord(said[step // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE step < 8 * length(said))),
        h AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS h FROM crc WHERE step = 8 * length(said)),
        w AS (SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, coalesce(h, 1) AS h FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id),
        a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM w),
        p AS (SELECT *, 1 + (len(words) - a) // (3 + (h // 10) % 8) AS p FROM a),
        v AS (SELECT doc_id, len(words) AS n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, len(words)), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS words FROM p),
        t AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(words) AS word FROM v),
        e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
        g AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
        s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM g GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        kept AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY t.doc_id),
        runs AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, arg_max({'s': start, 'l': length, 'p': period}, [length, -start, -period]) AS best FROM r GROUP BY doc_id)
        SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period, (1000 * best.l // best.p)::BIGINT AS exponent_milli,
            sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM v LEFT JOIN runs ON runs.doc_id = v.doc_id LEFT JOIN kept ON kept.doc_id = v.doc_id""",
    "op12_pivot_elimination": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS p FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id AS query_id, min(p) AS p FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
        s AS (SELECT query_id, vec_id, list_inner_product(q.p, v.p)::BIGINT AS score FROM q JOIN v ON vec_id <> query_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        QUALIFY rank <= 10""",
    "op13_length_strata": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
        d AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
        c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
        p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))) AS term
            FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)),
        s AS (SELECT item_id, row, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM i JOIN f USING (term) JOIN p USING (term) JOIN d USING (row), c GROUP BY item_id, row)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM s JOIN d USING (row) WHERE score > 0 QUALIFY rank <= 10""",
    "op9_grace_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
