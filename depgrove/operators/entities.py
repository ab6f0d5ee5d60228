"""Components that documents name, and the relations that their sentences state.

Components come from ordered evidence (file names, top headings, lists of what a document
provides, lists in overviews) and are merged by id.  Names in sentences are matched in
stages, each of which only sees what the stages before left; names inside names meet by
equi-joins on substrings, never by comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgrove.functions.text import VERB_FORMS, VERBS, stem
from depgrove.session import checkpointed

# Words that make a name a component's, and its type; the first decides.
TYPE_WORDS = {"database": "database", "gateway": "api", "service": "service", "api": "api", "db": "database", "config": "config", "setup": "config", "component": "service"}
# Words of file names and of overviews, endings that names may lack or have.
FILE_WORDS = ("service", "api", "gateway", "database", "db", "config", "setup")
OVERVIEWS = ("readme", "overview", "architecture", "index")
ENDINGS = ("-service", "-api", "-server", "-svc", "-backend", "-gateway")
SHORTENED = (" service", " api", " gateway", "-service", "-api", "-gateway")
# Words that are no subject or object.
NO_NAMES = "the a an it this that these those they we you i he she all each every some any no not also see note then which".split()
# Verbs around a named component, type of the relation and confidence; the first that occurs in a line decides.
CONTEXT = (
    (r"\b(?:depends?\s+on|relies?\s+on)\b", "depends-on", 0.75), (r"\b(?:requires?|needs?)\b", "depends-on", 0.70), (r"\b(?:calls?|invokes?|sends?\s+(?:request|data)\s+to)\b", "calls", 0.70),
    (r"\b(?:uses?|consumes?)\b", "mentions", 0.65), (r"\b(?:validates?\s+(?:via|through|using)|authenticates?\s+(?:via|through|using))\b", "depends-on", 0.70),
    (r"\b(?:integrates?\s+with|connects?\s+to|communicates?\s+with)\b", "depends-on", 0.65), (r"\b(?:processes?\s+(?:payment|order|request)s?\s+(?:for|from|via))\b", "calls", 0.65),
    (r"\b(?:stores?|persists?|records?)\s+.*\b(?:in|to)\b", "depends-on", 0.65),
)
PROVIDED = r"(?i)(?:provides|exposes|exports)\s*:\s*(.+)"
LISTED = r"(?i)^\s*(?:[-*+]|\d+\.)\s+(?:\*{0,2})?(\w[\w\s-]*?(?:Service|API|Gateway|Component|Database))(?:\*{0,2})?\s*(?:[-:]|$)"
FENCED = r"(?ms)^[^\S\n]*+(?:```|~~~).*?(?:\n[^\S\n]*+(?:```|~~~)[^\n]*+|\z)"
LEAST = 10


def normal(name: Column) -> Column:
    """Lower-case words joined by hyphens, without a file's extension."""
    plain = F.lower(F.replace(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit("_"), F.lit("-")))
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), " ", "-")


def _first_type(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(word)), F.lit(kind)) for word, kind in TYPE_WORDS.items()])


def _aliases(*names: Column) -> Column:
    forms = []
    for name in names:
        lower = F.lower(name)
        forms += [lower, normal(name), *[F.when(F.endswith(lower, F.lit(e)), F.regexp_replace(lower, f"{e}$", "")) for e in SHORTENED]]
    return F.array_distinct(F.filter(F.array_compact(F.array(*forms)), lambda a: a != ""))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def components(docs: DataFrame) -> DataFrame:
    """``id, name, type, file, aliases`` of what ``path, title, text`` documents name.

    Evidence counts in the order of paths, and within a document file name, headings,
    provided and listed names.  The first name stays; the first type that is known and
    the first file that is named count; aliases are united.  A component without a file
    gets the first document whose file name contains its id.  Nulls name nothing.
    """
    docs = docs.where("path IS NOT NULL").select("path", "title", F.coalesce("text", F.lit("")).alias("text"), stem(F.col("path")).alias("stem"))
    none = F.array().cast("array<string>")

    def row(df: DataFrame, turn: int, pos: Column, name: Column, kind: Column, file: Column, aliases: Column, id_of: Column) -> DataFrame:
        return df.select(normal(id_of).alias("id"), F.struct(F.col("path"), F.lit(turn).alias("turn"), pos.alias("pos")).alias("at"), name.alias("name"), F.coalesce(kind, F.lit("unknown")).alias("type"), file.alias("file"), aliases.alias("aliases"))

    by_file = docs.where(F.regexp(F.lower("stem"), F.lit("|".join(FILE_WORDS))))
    found = row(by_file, 1, F.lit(0), F.col("title"), _first_type(F.col("path")), F.col("path"), _aliases(F.col("stem"), F.coalesce("title", F.lit(""))), F.col("stem"))
    lines = docs.select("path", "stem", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    heading = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^#\s+", ""), r"\s*\{[^}]*\}$", ""))
    tops = lines.where(F.startswith(F.trim("line"), F.lit("# "))).withColumn("heading", heading).where(_first_type(F.col("heading")).isNotNull())
    found = found.unionByName(row(tops, 2, F.col("pos"), F.col("heading"), _first_type(F.col("heading")), F.col("path"), _aliases(F.col("heading"), F.col("stem")), F.col("heading")))
    given = lines.where(F.regexp(F.col("line"), F.lit(PROVIDED))).select("path", "pos", F.posexplode(F.split(F.regexp_extract("line", PROVIDED, 1), ",")).alias("n", "item")).withColumn("item", F.trim("item")).where("item != ''")
    found = found.unionByName(row(given, 3, F.col("pos") * 100_000 + F.col("n"), F.col("item"), F.lit(None).cast("string"), F.col("path"), none, F.col("item")))
    listed = lines.where(F.regexp(F.lower("path"), F.lit("|".join(OVERVIEWS)))).withColumn("item", F.trim(F.regexp_extract("line", LISTED, 1))).where("item != ''")
    found = found.unionByName(row(listed, 4, F.col("pos"), F.col("item"), _first_type(F.col("item")), F.lit(None).cast("string"), _aliases(F.col("item")), F.col("item")))
    known = lambda c, ok: F.min(F.when(ok, F.struct("at", F.col(c).alias("v"))))["v"]
    merged = found.where("id != ''").groupBy("id").agg(
        F.min(F.struct("at", F.col("name").alias("v")))["v"].alias("name"), F.coalesce(known("type", F.col("type") != "unknown"), F.lit("unknown")).alias("type"),
        known("file", F.col("file").isNotNull()).alias("file"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )
    merged = checkpointed(merged)
    named = inside(docs.select(F.lower("stem").alias("text")).distinct(), merged.where("file IS NULL").select("id", F.col("id").alias("name")))
    files = named.join(docs.select(F.lower("stem").alias("text"), "path"), "text").groupBy("id").agg(F.min("path").alias("by_name"))
    return merged.join(files, "id", "left").select("id", "name", "type", F.coalesce("file", "by_name").alias("file"), "aliases")


def inside(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``text, id``: the ``names(id, name)`` that occur in each ``text``, by an equi-join on the substrings that are as long as a name."""
    lengths = sorted(r[0] for r in names.select(F.length("name").alias("n")).where("n > 0").distinct().collect())  # one number a length
    if not lengths:
        return texts.limit(0).select("text", F.lit(None).cast("string").alias("id"))
    parts = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substr("text", i, F.lit(n))))
    every = texts.select("text", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n")).select("text", F.explode(F.array_distinct(parts(F.col("n")))).alias("name"))
    return every.join(names.select("id", "name").distinct(), "name").select("text", "id").distinct()


def matched(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``text, id, stage``: the component that each distinct ``text`` names; texts that name none are left out.

    Stages: the id itself; the id with or without an ending, in the order of ENDINGS;
    an alias (the least id); an id inside the text or around it, for texts of four
    characters or more (the longest id, then the least).
    """
    left = checkpointed(texts.select("text").where("text IS NOT NULL").distinct().withColumn("n", normal(F.col("text"))).where("n != ''"))
    ids = checkpointed(known.select("id").distinct())
    out = []

    def decide(found: DataFrame, stage: str) -> None:
        nonlocal left
        done = checkpointed(found.select("text", "id").withColumn("stage", F.lit(stage)))
        out.append(done)
        left = checkpointed(left.join(done, "text", "left_anti"))

    decide(left.join(ids, left["n"] == ids["id"]), "id")
    forms = F.flatten(F.array(*[F.array(F.struct(F.lit(2 * i).alias("order"), F.concat("n", F.lit(e)).alias("id")), F.struct(F.lit(2 * i + 1).alias("order"), F.when(F.endswith("n", F.lit(e)), F.regexp_replace("n", f"{e}$", "")).alias("id"))) for i, e in enumerate(ENDINGS)]))
    tried = left.select("text", F.explode(forms).alias("f")).select("text", "f.order", "f.id").join(ids, "id")
    decide(tried.groupBy("text").agg(F.min_by("id", "order").alias("id")), "ending")
    aliased = known.select("id", F.explode("aliases").alias("alias")).select("id", F.lower("alias").alias("n"))
    decide(left.join(aliased, "n").groupBy("text").agg(F.min("id").alias("id")), "alias")
    long = left.where(F.length("n") >= 4)
    # ids inside the name; and names inside ids, which share the first four characters at some place
    contained = inside(long.select(F.col("n").alias("text")).distinct(), ids.select("id", F.lower("id").alias("name"))).withColumnRenamed("text", "n")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("id") - 3, F.lit(1))), lambda i: F.substr(F.lower("id"), i, F.lit(4)))
    around = ids.select("id", F.explode(F.array_distinct(grams)).alias("gram")).join(long.select("n", F.substring("n", 1, 4).alias("gram")).distinct(), "gram").where(F.contains(F.lower("id"), F.col("n"))).select("n", "id")
    nearest = contained.select("n", "id").unionByName(around).distinct().groupBy("n").agg(F.min(F.struct((-F.length("id")).alias("order"), "id"))["id"].alias("id"))
    decide(long.join(nearest, "n"), "inside")
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _plain(line: Column) -> Column:
    """A line without its heading and list marks, emphasis and code ticks."""
    out = F.regexp_replace(F.trim(line), r"^#+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"^[- *+0-9.]+", ""), r"\*\*|__|`", ""))


def prose(docs: DataFrame) -> DataFrame:
    """``path, pos, line``: the lines outside code fences that are not empty."""
    open_ = docs.select("path", F.regexp_replace(F.coalesce("text", F.lit("")), FENCED, "").alias("text"))
    return _lines(open_).where(F.trim("line") != "")


def sentences(docs: DataFrame) -> DataFrame:
    """``path, pos, n, sentence``: sentences of ten characters or more outside code fences and headings.

    A sentence ends with . ? or ! before a blank or the end of its line.
    """
    lines = prose(docs).where(~F.startswith(F.trim("line"), F.lit("#"))).select("path", "pos", F.posexplode(F.split(_plain(F.col("line")), r"(?<=[.?!])(?= |$)")).alias("n", "sentence"))
    return lines.withColumn("sentence", F.trim("sentence")).where(F.length("sentence") >= LEAST)


def triples(said: DataFrame) -> DataFrame:
    """``path, pos, n, turn, subject, verb, object`` of clauses "subject verb object", names of several words included.

    A clause is a run of words that ends with . , ; : ! ? or the sentence; the first
    place of a verb divides it.  A last service-like word is no part of the object.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace("sentence", r"\[([^\]\[]++)\]\([^)]++\)", "$1"), r"\s+", " "))
    clauses = said.select("path", "pos", "n", F.posexplode(F.regexp_extract_all(clean, F.lit(r"([\w\s-]++)(?:[.,;:!?]|$)"), F.lit(1))).alias("c", "clause"))

    def one(turn: int, form: str, verb: str) -> Column:
        pattern = rf"(?i)^[\s-]*+(\w[\w\s-]*?)\s+(?:{form})\s+(?:the\s+)?(\w[\w\s-]*?)(?:\s+(?:service|api|server|backend|component))?\s*$"
        return F.struct(F.lit(turn).alias("turn"), F.trim(F.regexp_extract("clause", pattern, 1)).alias("subject"), F.lit(verb).alias("verb"), F.trim(F.regexp_extract("clause", pattern, 2)).alias("object"))

    found = clauses.where(F.regexp(F.col("clause"), F.lit("(?i)" + "|".join(form for form, _ in VERB_FORMS)))).select("path", "pos", "n", "c", F.explode(F.array(*[one(i, form, verb) for i, (form, verb) in enumerate(VERB_FORMS)])).alias("t"))
    rows = found.select("path", "pos", "n", "t.turn", "c", "t.subject", "t.verb", "t.object").where("subject != '' AND object != '' AND lower(subject) != lower(object)")
    rows = rows.where(~F.lower("subject").isin(*NO_NAMES) & ~F.lower("object").isin(*NO_NAMES))
    return rows.groupBy("path", "pos", "n", F.lower("subject").alias("s"), "verb", F.lower("object").alias("o")).agg(F.min(F.struct("turn", "c", "subject", "object")).alias("x")).select("path", "pos", "n", "x.turn", "x.subject", "verb", "x.object")


def relations(docs: DataFrame) -> DataFrame:
    """``src, dst, type, confidence``: edges between the documents of the components that sentences and lines relate.

    Where only the object of a triple is a component, the document's own is the subject.
    Lines with a verb of CONTEXT relate the document's component to every component that
    the line names.  Of several statements on a pair the most certain counts, then the
    first.  ``docs`` has ``path, title, text``.
    """
    docs = checkpointed(docs.where("path IS NOT NULL").select("path", "title", "text"))
    known = checkpointed(components(docs))
    own = known.where("file IS NOT NULL").groupBy(F.col("file").alias("path")).agg(F.min("id").alias("own"))
    told = checkpointed(triples(sentences(docs)))
    names = matched(told.select(F.col("subject").alias("text")).unionByName(told.select(F.col("object").alias("text"))), known).select("text", "id")
    file = known.where("file IS NOT NULL").select("id", "file")
    resolved = told.join(names.withColumnsRenamed({"text": "object", "id": "o"}), "object").join(names.withColumnsRenamed({"text": "subject", "id": "s"}), "subject", "left").join(own, "path", "left")
    kind = F.create_map(*[F.lit(x) for v, (t, _) in VERBS.items() for x in (v, t)])[F.col("verb")]
    score = F.create_map(*[F.lit(x) for v, (_, c) in VERBS.items() for x in (v, c)])[F.col("verb")]
    stated = resolved.select(F.coalesce("s", "own").alias("s"), "o", F.coalesce(kind, F.lit("mentions")).alias("type"), F.coalesce(score, F.lit(0.6)).alias("confidence"), F.struct(F.lit(0).alias("by"), "path", "pos", "n", "turn").alias("at"))
    lines = prose(docs).join(own, "path").withColumn("text", F.lower(_plain(F.col("line")))).where(F.length("text") >= LEAST)
    verbs = F.coalesce(*[F.when(F.regexp(F.col("text"), F.lit(p)), F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))) for p, t, c in CONTEXT])
    lines = checkpointed(lines.withColumn("v", verbs).where("v IS NOT NULL").select("path", "pos", "own", "text", "v"))
    called = known.select("id", F.explode(F.concat(F.array(F.lower("name")), F.filter("aliases", lambda a: F.length(a) >= 3))).alias("name")).where("name != ''")
    hits = inside(lines.select("text").distinct(), called)
    context = lines.join(hits, "text").where("id != own").select(F.col("own").alias("s"), F.col("id").alias("o"), "v.type", "v.confidence", F.struct(F.lit(1).alias("by"), "path", "pos", F.lit(0).alias("n"), F.lit(0).alias("turn")).alias("at"))
    both = stated.where("s IS NOT NULL").unionByName(context)
    placed = both.join(file.withColumnsRenamed({"id": "s", "file": "src"}), "s").join(file.withColumnsRenamed({"id": "o", "file": "dst"}), "o").where("src != dst")
    best = placed.groupBy("src", "dst").agg(F.min(F.struct((-F.col("confidence")).alias("order"), "at", "type", "confidence")).alias("x"))
    return best.select("src", "dst", "x.type", "x.confidence")
