"""Relationship discovery in documents."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgrove.functions.text import DEPENDENCY_SECTIONS, VERB_FORMS, VERB_STEMS, VERBS, links, resolved_path, tokens
from depgrove.operators.sections import chunks
from depgrove.session import checkpointed


def windows(rows: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, pos, text, share``: every line with the next ones, and its place in the document."""
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, size - 1)
    return rows.select("doc_id", "pos", F.array_join(F.collect_list("line").over(ahead), " ").alias("text"), (F.col("pos") / F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).alias("share"))


def position_weight(share):
    """Earlier mentions weigh more."""
    return F.when(share < 0.3, 0.65).when(share < 0.6, 0.55).otherwise(0.45)


def lexicon_hits(rows: DataFrame, lexicon: DataFrame, text: str = "line") -> DataFrame:
    """``doc_id, pos, name``: lexicon names among the tokens of a row, by an equi-join on the token."""
    words = rows.select("doc_id", "pos", F.explode(F.array_distinct(tokens(F.col(text)))).alias("name"))
    return words.join(lexicon.select("name"), "name")


def cooccurrence(rows: DataFrame, lexicon: DataFrame, size: int = 5) -> DataFrame:
    """``src, dst, confidence, doc_id, pos``: names that meet in a window of lines.

    The name that stands first points to the later one; the first window of the
    smallest document gives the confidence.
    """
    hits = checkpointed(lexicon_hits(rows, lexicon))  # made by one pass over the text, read on both sides
    # positions at most ``size - 1`` apart lie in the same bucket of ``size`` or in the next, so no document is joined with itself as a whole
    a = hits.select("doc_id", F.col("pos").alias("pa"), F.col("name").alias("src"), F.explode(F.array(F.floor(F.col("pos") / size), F.floor(F.col("pos") / size) + 1)).alias("bucket"))
    b = hits.select("doc_id", F.col("pos").alias("pb"), F.col("name").alias("dst"), F.floor(F.col("pos") / size).alias("bucket"))
    near = (F.col("pb") >= F.col("pa")) & (F.col("pb") < F.col("pa") + size) & ((F.col("pb") > F.col("pa")) | (F.col("src") < F.col("dst")))
    pairs = a.join(b, ["doc_id", "bucket"]).where(near & (F.col("src") != F.col("dst")))
    # least documents and places by a merging aggregate, so a common pair is not sorted in one task; only their documents are counted
    least = pairs.groupBy("src", "dst").agg(F.min(F.struct("doc_id", "pa", "pb")).alias("x"))
    best = checkpointed(least.select("src", "dst", "x.doc_id", "x.pa"))
    total = rows.join(best.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    best = best.join(total, "doc_id")
    return best.select("src", "dst", position_weight(F.col("pa") / F.col("total")).alias("confidence"), "doc_id", F.col("pa").alias("pos"))


def dependency_sections(docs: DataFrame) -> DataFrame:
    """Chunks of ``doc_id, text`` documents whose heading names dependencies."""
    last = F.lower(F.element_at(F.split(F.col("heading_path"), " > "), -1))
    return chunks(docs).where(last.rlike("|".join(DEPENDENCY_SECTIONS)))


def structural(docs: DataFrame, lexicon: DataFrame, merged: bool = True) -> DataFrame:
    """``src, dst, confidence``: names listed in a document's dependency sections; table rows count less.

    Where they are not ``merged``, a name has a row for every section and kind of line.
    """
    inside = dependency_sections(docs).select("doc_id", "content")
    row = lambda line: F.startswith(F.ltrim(line), F.lit("|"))
    stated = lambda text: F.lower(text).rlike(r"depends on|requires")
    of = lambda kept: F.array_join(F.filter(F.split("content", "\n", -1), kept), "\n")
    # a section gives a name once for each kind of line, so a word that all lines share is no row for each of them
    tables = F.when(F.contains("content", F.lit("|")), of(row))
    said = F.when(stated(F.col("content")), of(lambda line: ~row(line) & stated(line)))
    plain = F.when(tables.isNull() & said.isNull(), F.col("content")).otherwise(of(lambda line: ~row(line) & ~stated(line)))
    kinds = inside.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("confidence"), t.alias("text")) for c, t in ((0.75, tables), (0.85, said), (0.8, plain))])).alias("k")).where("k.text != ''")
    hits = kinds.select("doc_id", "k.confidence", F.explode(F.array_distinct(tokens(F.col("k.text")))).alias("name")).join(lexicon.select("name"), "name", "left_semi")
    rows = hits.select(F.col("doc_id").alias("src"), F.col("name").alias("dst"), "confidence").where(F.col("doc_id").cast("string") != F.col("name"))
    return rows.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")) if merged else rows


def canonical_verb(form: Column) -> Column:
    """The verb that a form stands for; null for none."""
    return F.coalesce(*[F.when(F.regexp(F.lower(form), F.lit(rf"^{pattern}$")), F.lit(verb)) for pattern, verb in VERB_FORMS])


def triples(rows: DataFrame) -> DataFrame:
    """``doc_id, pos, subject, verb, object, type, confidence`` of "a <verb> b" in a line, any form of the verbs."""
    forms = "|".join(pattern for pattern, _ in VERB_FORMS)
    # a subject begins where its run of characters does, and gives nothing back: the time is linear in the line
    pattern = rf"[0-9-]*+([A-Za-z][A-Za-z0-9-]*+)\s++({forms})\s++(?:the\s++)?([A-Za-z][A-Za-z0-9-]*+)"
    every = F.regexp_extract_all("line", F.lit(rf"(?i)(?<![A-Za-z0-9-]){pattern}"), F.lit(0))
    # what was found is short and is taken apart once, at a character that it cannot hold
    apart = F.transform(every, lambda m: F.split(F.regexp_replace(m, rf"(?i)^{pattern}$", "$1\x00$2\x00$3"), "\x00"))
    stems = reduce(or_, [F.contains(F.lower("line"), F.lit(x)) for x in VERB_STEMS])  # plain searches, so most lines meet no pattern
    parts = rows.where(stems).select("doc_id", "pos", F.explode(apart).alias("t"))
    verbs = parts.select("doc_id", "pos", F.lower(F.col("t")[0]).alias("subject"), canonical_verb(F.col("t")[1]).alias("verb"), F.lower(F.col("t")[2]).alias("object"))
    kind = F.create_map(*[F.lit(x) for v, (t, _) in VERBS.items() for x in (v, t)])[F.col("verb")]
    score = F.create_map(*[F.lit(x) for v, (_, c) in VERBS.items() for x in (v, c)])[F.col("verb")]
    return verbs.select("doc_id", "pos", "subject", "verb", "object", kind.alias("type"), score.alias("confidence"))


def relations(rows: DataFrame) -> DataFrame:
    """Best triple per pair as an edge."""
    t = triples(rows).where("subject != object")
    # a place among the types, by confidence and name, is moved instead of both
    kinds = sorted({(score, kind) for kind, score in VERBS.values()})
    place = F.create_map(*[F.lit(x) for v, (kind, score) in VERBS.items() for x in (v, kinds.index((score, kind)) + 1)])[F.col("verb")]
    best = t.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max(place).alias("place"), F.count(F.lit(1)).alias("mentions"))
    of = F.element_at(F.array(*[F.struct(F.lit(score).alias("confidence"), F.lit(kind).alias("type")) for score, kind in kinds]), F.col("place"))
    return best.select("src", "dst", of["confidence"].alias("confidence"), of["type"].alias("type"), "mentions")


def link_edges(docs: DataFrame, paths: DataFrame, merged: bool = True) -> DataFrame:
    """``src, dst, type, confidence``: relative links; 1.0 where the target is a known path, else 0.5.

    Where they are not ``merged``, rows of ``docs`` with one path repeat their links.
    """
    found = docs.select(F.col("path").alias("src"), F.explode(F.array_distinct(links(F.col("text")))).alias("target"))
    folder = F.regexp_extract("src", "^(.*/)", 1)
    clean = resolved_path(F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat(folder, "target")))
    edges = found.select("src", clean.alias("dst")).where((F.col("dst") != "") & (F.col("src") != F.col("dst")))
    edges = edges.distinct() if merged else edges
    return edges.join(paths.select(F.col("path").alias("dst"), F.lit(1.0).alias("known")), "dst", "left").select("src", "dst", F.lit("references").alias("type"), F.coalesce("known", F.lit(0.5)).alias("confidence"))


def mentions(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, name, confidence, lines``: code ticks .9, elsewhere .7; the best line counts."""
    ticked = lambda t: F.contains(F.lower("line"), F.concat(F.lit("`"), t, F.lit("`")))
    words = rows.select("doc_id", F.explode(F.transform(F.array_distinct(tokens(F.col("line"))), lambda t: F.struct(t.alias("name"), ticked(t).alias("ticked")))).alias("w")).select("doc_id", "w.name", "w.ticked")
    hits = words.join(lexicon.select("name"), "name")
    return hits.groupBy("doc_id", "name").agg(F.max(F.when(F.col("ticked"), 0.9).otherwise(0.7)).alias("confidence"), F.count(F.lit(1)).alias("lines"))


# Name, type, pattern, confidence of infrastructure named in prose; iam counts only beside a word of use.
INFRASTRUCTURE = (
    ("dynamodb", "database", "dynamodb", 0.85), ("postgresql", "database", "postgresql|postgres", 0.85), ("mysql", "database", "mysql", 0.85), ("mongodb", "database", "mongodb|mongo", 0.85),
    ("redis", "cache", "redis", 0.85), ("cassandra", "database", "cassandra", 0.85), ("aurora", "database", "aurora|aws aurora", 0.85), ("rds", "database", "rds|aws rds|amazon rds", 0.80),
    ("s3", "storage", "s3|aws s3|amazon s3", 0.85), ("aws-secrets-manager", "secrets-manager", "secrets manager|aws secrets manager|secretsmanager", 0.85),
    ("kms", "secrets-manager", "kms|aws kms|key management service", 0.80), ("cloudformation", "config-server", "cloudformation|aws cloudformation", 0.85),
    ("sns", "queue", "sns|aws sns", 0.80), ("sqs", "queue", "sqs|aws sqs", 0.80), ("kinesis", "queue", "kinesis|aws kinesis", 0.85), ("lambda", "service", "lambda|aws lambda", 0.85),
    ("ecr", "container-registry", "ecr|aws ecr", 0.80), ("eks", "orchestrator", "eks|aws eks", 0.80), ("iam", "service", "iam|aws iam", 0.75),
    ("ldap", "service", "ldap", 0.85), ("active-directory", "service", "active directory|activedirectory", 0.80), ("okta", "service", "okta", 0.85), ("oauth", "service", "oauth", 0.75),
    ("kafka", "message-broker", "kafka|apache kafka", 0.85), ("rabbitmq", "message-broker", "rabbitmq", 0.85), ("nats", "message-broker", "nats", 0.85), ("eventbridge", "message-broker", "eventbridge", 0.85),
    ("prometheus", "monitoring", "prometheus", 0.85), ("datadog", "monitoring", "datadog", 0.85), ("grafana", "monitoring", "grafana", 0.85), ("pagerduty", "monitoring", "pagerduty|pager duty", 0.85),
    ("new-relic", "monitoring", "new relic|newrelic", 0.85), ("vault", "secrets-manager", "vault|hashicorp vault", 0.85), ("haproxy", "load-balancer", "haproxy", 0.85), ("nginx", "load-balancer", "nginx", 0.85),
    ("envoy", "load-balancer", "envoy", 0.85), ("alb", "load-balancer", "alb|application load balancer", 0.80), ("elasticsearch", "search", "elasticsearch", 0.85), ("opensearch", "search", "opensearch", 0.85),
    ("kubernetes", "orchestrator", "kubernetes|k8s", 0.85), ("docker", "orchestrator", "docker", 0.75), ("consul", "config-server", "consul", 0.85), ("etcd", "config-server", "etcd", 0.85),
)
# Words of use.
USE_WORDS = ("use", "connect", "store", "access", "authenticate", "deploy", "manage")


def infrastructure(rows: DataFrame) -> DataFrame:
    """``doc_id, name, type, confidence, line, evidence``: infrastructure that a document names, at its first line (from 1).

    Lines under three characters are passed over; the evidence is the line, cut at 100 characters.
    One pass over the lines; only the lines that name something are grouped.
    """

    def named(name: str, kind: str, pattern: str, confidence: float) -> Column:
        hit = F.regexp(F.col("line"), F.lit(rf"(?i)\b(?:{pattern})\b"))
        if name == "iam":
            hit &= F.regexp(F.lower("line"), F.lit("|".join(USE_WORDS)))
        return F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))

    any_of = "|".join(pattern for _, _, pattern, _ in INFRASTRUCTURE)
    lines = rows.where((F.length(F.trim("line")) >= 3) & F.regexp(F.col("line"), F.lit(rf"(?i)\b(?:{any_of})\b")))
    hits = lines.select("doc_id", "pos", "line", F.explode(F.array_compact(F.array(*[named(*row) for row in INFRASTRUCTURE]))).alias("x"))
    evidence = F.trim(F.when(F.length("line") > 100, F.concat(F.substring("line", 1, 100), F.lit("..."))).otherwise(F.col("line")))
    first = hits.groupBy("doc_id", "x.name", "x.type", "x.confidence").agg(F.min(F.struct("pos", evidence.alias("evidence"))).alias("first"))
    return first.select("doc_id", "name", "type", "confidence", (F.col("first.pos") + 1).cast("int").alias("line"), F.col("first.evidence").alias("evidence"))
