"""Registered queries over the driver's tables; ``oracles`` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depgrove.functions import evidence as conf
from depgrove.functions import text as tx
from depgrove.operators import changes, chunk_index, classify, codescan, context, cycles, discover, entities, evidence, graph, registry, search, sections, vectors
from depgrove.session import checkpointed, shared_folder, table
from depgrove.sources import derived
from depgrove.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters of the registered queries, used by their SQL too.
PART = "part-1"
TERMS = ["the", "est", "der", "thand", "that"]
INDEX_TERMS = ["calls", "dependencies", "redis", "notes", "redis-cluster", "part-1"]
LEXICON = ["thing", "tion", "sont", "eine", "thand", "edst"]

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- graph ---------------------------------------------------------------------------


@query
def impact_depth3(spark, sf):
    return graph.impact(derived.part_edges(spark, sf), PART, 3).select(F.col("id").alias("name"), "distance", "via", "confidence_tier")


@query
def dependencies_depth2_confident(spark, sf):
    return graph.dependencies(derived.part_edges(spark, sf), PART, 2, 0.5).select(F.col("id").alias("name"), "distance", "via", "confidence_tier")


@query
def dependencies_source_type(spark, sf):
    return graph.dependencies(derived.part_edges(spark, sf), PART, 2, source_type="markdown").select(F.col("id").alias("name"), "distance")


@query
def closure_events(spark, sf):
    return graph.closure(derived.event_edges(spark, sf))


@query
def reach_all(spark, sf):
    edges = derived.part_edges(spark, sf).where("confidence > 0.5")
    return graph.reach(edges, spark.createDataFrame([(PART,)], "id string"), "both", None)


@query
def simple_paths_le4(spark, sf):
    found = graph.simple_paths(derived.event_edges(spark, sf), 4)
    return found.select(F.array_join("path", ">").alias("path"), "hops", F.round("confidence", 6).alias("confidence"))


@query
def k_shortest_paths(spark, sf):
    edges = derived.event_edges(spark, sf)
    ends = edges.agg(F.min("src").alias("a"), F.max("dst").alias("b")).first()
    return graph.k_shortest(edges, ends["a"], ends["b"], 5, 4).select(F.col("rank").cast("long").alias("rank"), "route", "hops", F.round("confidence", 6).alias("confidence"))


@query
def cycles_canonical(spark, sf):
    return graph.cycles(derived.event_edges(spark, sf), 5).select(F.array_join("cycle", ">").alias("cycle"), "length")


@query
def cycle_edges(spark, sf):
    found = graph.cycles(derived.event_edges(spark, sf), 4)
    hop = F.explode(F.zip_with(F.slice("cycle", 1, F.size("cycle") - 1), F.slice("cycle", 2, F.size("cycle")), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    return found.select(hop.alias("e")).groupBy("e.src", "e.dst").agg(F.count(F.lit(1)).alias("cycles"))


@query
def induced_subgraph(spark, sf):
    return graph.induced(derived.part_edges(spark, sf), PART, 1).select("src", "dst", "confidence")


@query
def crawl_two_starts(spark, sf):
    starts = spark.createDataFrame([("part-1",), ("part-2",)], "id string")
    edges = derived.part_edges(spark, sf).where("confidence > 0.5")
    return graph.crawl(edges, starts, "forward", 2).select("id", "depth", F.array_join("parents", ",").alias("parents"), "edges_out")


@query
def crawl_backward(spark, sf):
    starts = spark.createDataFrame([("part-1",), ("part-2",)], "id string")
    edges = derived.part_edges(spark, sf).where("confidence > 0.5")
    return graph.crawl(edges, starts, "backward", 2).select("id", "depth", F.array_join("parents", ",").alias("parents"), "edges_out")


@query
def crawl_both(spark, sf):
    starts = spark.createDataFrame([("part-1",), ("part-2",)], "id string")
    edges = derived.part_edges(spark, sf).where("confidence > 0.5")
    return graph.crawl(edges, starts, "both", 2).select("id", "depth", F.array_join("parents", ",").alias("parents"), "edges_out")


@query
def cycle_membership(spark, sf):
    """Components of the event graph and of rings of each nation's customers, which hang on chains of suppliers."""
    events = derived.event_edges(spark, sf).select("src", "dst")
    return cycles.strongly_connected(events.unionByName(derived.customer_rings(spark, sf)))


@query
def cyclic_dependencies(spark, sf):
    return cycles.cyclic_edges(derived.part_edges(spark, sf).where("confidence > 0.5").select("src", "dst"))


@query
def traversal_tags(spark, sf):
    starts = spark.createDataFrame([("supplier-1",), ("supplier-2",), ("view",)], "id string")
    edges = derived.event_edges(spark, sf).select("src", "dst").unionByName(derived.customer_rings(spark, sf))
    return cycles.traversed(edges, starts).select("src", "dst", "relationship")


@query
def crawl_cycle_classes(spark, sf):
    starts = derived.customer_rings(spark, sf).where("src LIKE 'supplier-%'").select(F.col("src").alias("id")).distinct()
    edges = derived.customer_rings(spark, sf).withColumn("confidence", F.lit(1.0))
    return cycles.crawl_cycles(edges, starts).select("component", F.array_join("members", ",").alias("members"), "size", "kind")


@query
def documented_context(spark, sf):
    docs = derived.component_documents(spark, sf).select(F.col("doc_id").alias("id"), "text")
    found = context.documented(derived.part_edges(spark, sf), PART, docs, 2, 20_000)
    return found.select("id", "distance", F.length("text").cast("long").alias("taken"), F.md5(F.col("text").cast("binary")).alias("digest"), "cut")


@query
def context_relations(spark, sf):
    return context.related(derived.part_edges(spark, sf), PART, 2)


@query
def attenuated_reach(spark, sf):
    out = graph.attenuated(derived.event_edges(spark, sf), "click", 0.3, 3)
    return out.select("id", F.round("confidence", 6).alias("confidence"))


@query
def degree_list(spark, sf):
    return graph.listing(*derived.entity_graph(spark, sf))


@query
def list_filtered(spark, sf):
    return graph.listing(*derived.entity_graph(spark, sf), component_type="database", min_confidence=0.75)


@query
def orphan_nodes(spark, sf):
    nodes, edges = derived.entity_graph(spark, sf)
    return graph.orphans(nodes, edges.where("confidence >= 0.9")).select("id", "component_type")


@query
def dangling_edges(spark, sf):
    nodes, edges = derived.entity_graph(spark, sf)
    return graph.dangling(nodes.where("title != 'FRANCE' AND id NOT LIKE '%7'"), edges).select("src", "dst")


@query
def pruned_edges(spark, sf):
    nodes, edges = derived.entity_graph(spark, sf)
    return graph.pruned(nodes.where("id NOT LIKE '%7'"), edges).select("src", "dst", "confidence")


@query
def weak_only_nodes(spark, sf):
    return graph.weak_only(derived.entity_graph(spark, sf)[1])


@query
def tier_distribution(spark, sf):
    return graph.tier_distribution(derived.part_edges(spark, sf))


@query
def graph_stats(spark, sf):
    return graph.stats(*derived.entity_graph(spark, sf))


@query
def nodes_by_type(spark, sf):
    nodes, _ = derived.entity_graph(spark, sf)
    return nodes.groupBy("component_type").agg(F.count(F.lit(1)).alias("nodes"), F.min("id").alias("first"), F.max("id").alias("last"))


@query
def lifted_components(spark, sf):
    files = table(spark, sf, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("file"), F.col("p_brand").alias("component"))
    return graph.lifted(derived.part_edges(spark, sf), files)


@query
def merged_sources(spark, sf):
    edges = derived.part_edges(spark, sf)
    out = graph.merge_sources(edges.where("n = 1 OR n > 2"), edges.where("n > 1"))
    return out.select("src", "dst", F.round("confidence", 6).alias("confidence"), "source_type")


@query
def alias_rewrite(spark, sf):
    names = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("part-"), "p_partkey").alias("alias"), F.col("p_brand").alias("canonical_id"))
    return graph.renamed(derived.part_edges(spark, sf), names)


@query
def hypotheses_missing(spark, sf):
    nodes, edges = derived.entity_graph(spark, sf)
    return graph.hypotheses(nodes, edges, "database", "gateway", 0.4)


@query
def valid_edges(spark, sf):
    edges = derived.part_edges(spark, sf)
    ok = conf.valid_edge(F.col("src"), F.col("dst"), F.col("confidence")) & conf.at_least_tier(F.col("confidence"), "strong-inference")
    return edges.where(ok).groupBy("src").agg(F.count(F.lit(1)).alias("edges"))


# --- evidence ------------------------------------------------------------------------


@query
def merge_signals_max(spark, sf):
    return evidence.merge_max(derived.signals(spark, sf))


@query
def merge_signals_weighted(spark, sf):
    return evidence.merge_weighted(derived.signals(spark, sf))


@query
def merge_signals_by_location(spark, sf):
    return evidence.merge_weighted(derived.signals(spark, sf), ["src", "dst", "evidence"])


@query
def merge_signals_registry(spark, sf):
    return evidence.merge_registry(derived.signals(spark, sf))


@query
def merge_signals_hybrid(spark, sf):
    return evidence.merge_hybrid(derived.signals(spark, sf), 0.5, "weighted")


@query
def noisy_or_sources(spark, sf):
    return evidence.independent(derived.signals(spark, sf))


@query
def quality_gate(spark, sf):
    return evidence.quality_gate(derived.signals(spark, sf))


@query
def edge_keep_best(spark, sf):
    order = [F.col("evidence"), F.col("type"), F.col("algorithm"), F.col("weight")]
    return evidence.keep_best(derived.signals(spark, sf), ["src", "dst"], order).select("src", "dst", "confidence", "evidence")


@query
def edge_keep_first(spark, sf):
    order = [F.col("evidence"), F.col("confidence"), F.col("type")]
    return evidence.keep_first(derived.signals(spark, sf), ["src", "dst"], order).select("src", "dst", "evidence", "confidence")


@query
def distinct_signals(spark, sf):
    return evidence.distinct_signals(derived.signals(spark, sf))


@query
def evidence_summary(spark, sf):
    return evidence.summary(derived.signals(spark, sf))


@query
def review_manifest(spark, sf):
    decided = derived.signals(spark, sf).where("confidence > 0.85").select("src", "dst", F.lit("accepted").alias("status")).distinct()
    return evidence.manifest_summary(evidence.manifest(derived.signals(spark, sf), decided))


# --- search --------------------------------------------------------------------------


@query
def bm25_topk(spark, sf):
    return search.bm25(table(spark, sf, "documents"), TERMS, 20)


@query
def term_stats(spark, sf):
    return search.term_stats(search.postings(table(spark, sf, "documents")))


@query
def corpus_stats(spark, sf):
    out = search.corpus_stats(table(spark, sf, "documents"))
    return out.select("n", F.round("mean_length", 4).alias("mean_length"))


@query
def tfidf_pairs(spark, sf):
    pages = table(spark, sf, "pages")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    # a text is less to move than its postings, which are counted where it arrives
    post = checkpointed(search.postings(docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")))
    return search.similar_documents(post, pages.count(), 0.35)


@query
def suggest_names(spark, sf):
    return search.suggestions(derived.entity_graph(spark, sf)[0].select(F.col("id").alias("name")), "suplier 1", 5)


@query
def search_snippets(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit(TERMS[3])))
    return docs.select("doc_id", tx.snippet(F.col("text"), F.lit(TERMS[3])).alias("snippet"))


# --- documents -----------------------------------------------------------------------


@query
def document_chunks(spark, sf):
    return sections.chunks(derived.component_documents(spark, sf)).drop("chunk_id")


@query
def section_tree(spark, sf):
    return sections.tree(derived.component_documents(spark, sf))


def edited_documents(docs):
    """Component documents after an edit: some gone, some with another line, some new under another name."""
    kept = docs.where("doc_id NOT LIKE '%7'").select("doc_id", F.when(F.col("doc_id").like("%5"), F.concat("text", F.lit("\n### Cache\n\nredis cache, redis-cluster\n"))).otherwise(F.col("text")).alias("text"))
    return kept.unionByName(docs.where("doc_id LIKE '%3'").select(F.concat(F.lit("new-"), "doc_id").alias("doc_id"), "text"))


def updated_index(spark, sf):
    """An index of the component documents, brought to their edited state."""
    docs = checkpointed(derived.component_documents(spark, sf).select("doc_id", "text"))
    index = chunk_index.ChunkIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.update(docs)
    index.update(edited_documents(docs), docs.where("doc_id LIKE '%7'").select("doc_id"))
    return index


@query
def chunk_index_search(spark, sf):
    return updated_index(spark, sf).search(INDEX_TERMS, 20)


@query
def chunk_index_frequencies(spark, sf):
    return updated_index(spark, sf).frequencies()


@query
def line_windows(spark, sf):
    rows = tx.lines(table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("text").alias("text")).withColumnRenamed("conv_id", "doc_id"))
    return discover.windows(rows).select("doc_id", F.col("pos").cast("long").alias("pos"), "text", discover.position_weight(F.col("share")).alias("weight"))


@query
def line_windows_all(spark, sf):
    turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = table(spark, sf, "conversations").where("text IS NOT NULL").withColumn("copy", F.row_number().over(turn).cast("long"))
    keyed = rows.select(F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.coalesce(F.col("turn").cast("string"), F.lit("-")), "copy").alias("doc_id"), "text")
    return discover.windows(tx.lines(keyed)).select("doc_id", F.col("pos").cast("long").alias("pos"), "text", discover.position_weight(F.col("share")).alias("weight"))


@query
def turn_windows(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("line")).distinct()
    return discover.windows(rows).select("doc_id", "pos", "text")


@query
def cooccurrence_window5(spark, sf):
    names = spark.createDataFrame([(x,) for x in LEXICON], "name string")
    return discover.cooccurrence(tx.lines(table(spark, sf, "documents")), names).withColumn("pos", F.col("pos").cast("long"))


@query
def lexicon_mentions(spark, sf):
    names = spark.createDataFrame([(x,) for x in LEXICON], "name string")
    return discover.mentions(tx.lines(table(spark, sf, "documents")), names)


@query
def structural_dependencies(spark, sf):
    docs = derived.component_documents(spark, sf)
    return discover.structural(docs, docs.select(F.col("doc_id").alias("name")))


@query
def named_components(spark, sf):
    return entities.components(derived.service_documents(spark, sf)).select("id", "name", "type", "file")


@query
def sentence_split(spark, sf):
    return entities.sentences(derived.service_documents(spark, sf)).select("path", "sentence")


@query
def matched_components(spark, sf):
    docs = derived.service_documents(spark, sf)
    said = entities.triples(entities.sentences(docs))
    names = said.select(F.col("subject").alias("text")).unionByName(said.select(F.col("object").alias("text")))
    return entities.matched(names, checkpointed(entities.components(docs)))


@query
def entity_relations(spark, sf):
    return entities.relations(derived.service_documents(spark, sf))


@query
def registry_components(spark, sf):
    return registry.components(derived.service_documents(spark, sf).select(F.col("path").alias("id"), "title"))


@query
def registry_relations(spark, sf):
    """Links, stated relations and listed dependencies of the component documents in one registry."""
    docs = checkpointed(derived.component_documents(spark, sf))
    rows = tx.lines(docs)
    # paths and names occur once; uniting merges what repeats inside a document
    linked = registry.signals(discover.link_edges(docs, docs.select("path"), merged=False), "link", F.col("dst"))
    stated = registry.signals(discover.relations(rows), "mention", F.concat(F.lit("stated: "), "type"))
    listed = registry.signals(discover.structural(docs, docs.select(F.col("doc_id").alias("name")), merged=False).select(F.col("src").cast("string").alias("src"), "dst", "confidence"), "mention", F.lit("listed"))
    out = registry.relations(registry.united(linked, stated, listed, parts=derived.parts(spark, table(spark, sf, "lineitem").count())))
    return out.select("src", "dst", "confidence", F.array_join(F.map_keys("by_kind"), ",").alias("kinds"), "signals", F.col("by_kind")["mention"]["evidence"].alias("mention"))


@query
def verb_relations(spark, sf):
    return discover.relations(tx.lines(derived.component_documents(spark, sf)))


@query
def link_edges(spark, sf):
    docs = derived.component_documents(spark, sf)
    return discover.link_edges(docs, docs.select("path"))


@query
def document_titles(spark, sf):
    docs = derived.component_documents(spark, sf)
    return docs.select("doc_id", tx.title(F.col("text"), F.col("path")).alias("title"), F.length(tx.strip_markdown(F.col("text"))).cast("long").alias("plain_chars"), tx.directory(F.col("path")).alias("folder"))


@query
def page_links(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.explode(tx.hrefs(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query
def page_hosts(spark, sf):
    host = tx.connection_host(F.col("url"))
    return table(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query
def connection_strings(spark, sf):
    return derived.connections(spark, sf).select("src", tx.connection_target(F.col("value")).alias("host"), tx.connection_type(F.col("value")).alias("type"))


@query
def infrastructure_mentions(spark, sf):
    """Infrastructure named in any connection string or web page; the page's lines count like a document's."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page-"), "page_id").alias("doc_id"), F.col("html").alias("text"))
    strings = derived.connections(spark, sf).select(F.col("src").alias("doc_id"), F.col("value").alias("text"))
    return discover.infrastructure(tx.lines(pages.unionByName(strings)))


@query
def name_aliases(spark, sf):
    parts = table(spark, sf, "part").select(F.concat("p_name", F.lit(" Service")).alias("name")).distinct()
    return parts.select("name", F.explode(tx.aliases(F.col("name"))).alias("alias"))


# --- classification, vectors, change ---------------------------------------------------


@query
def component_types(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lower(F.col("p_type")), F.element_at(F.array(*[F.lit(x) for x in (" api", " redis cache", " worker", " db", " queue", " gateway")]), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))).alias("name"))
    # the names are few bytes in few files, what is looked up for them is not little
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select("p_partkey", classify.inferred_type(F.col("name")).alias("t")).select("p_partkey", "t.type", "t.confidence")


@query
def detected_components(spark, sf):
    nodes, edges = derived.entity_graph(spark, sf)
    return classify.detected(nodes, graph.degrees(edges))


@query
def longest_prefix_components(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("file"))
    by_source = docs.select(F.concat(F.lit("src/"), "source").alias("path"), F.col("source").alias("component")).distinct()
    by_lang = docs.where("lang = 'en'").select(F.concat(F.lit("src/"), "source", F.lit("/en")).alias("path"), F.concat("source", F.lit("-en")).alias("component")).distinct()
    return classify.longest_prefix(files, by_source.unionByName(by_lang))


@query
def vector_topk(spark, sf):
    return vectors.nearest(table(spark, sf, "embeddings"), 0, 10)


@query
def vector_topk_all(spark, sf):
    return vectors.nearest_to_each(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def vector_centroids(spark, sf):
    return vectors.centroids(table(spark, sf, "embeddings")).withColumn("place", F.col("place").cast("long"))


@query
def change_detection(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 5 != 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"))
    return changes.changes(old, docs.where("doc_id % 11 != 0"))


@query
def document_upsert(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    fresh = docs.where("doc_id % 4 = 1").select("doc_id", F.upper("lang").alias("lang"))
    return changes.upserted(docs.where("doc_id % 3 != 0"), fresh, ["doc_id"])


# --- provenance, registry and components -------------------------------------------------


@query
def provenance_errors(spark, sf):
    rows = table(spark, sf, "lineitem")
    of = F.pmod("l_partkey", F.lit(5))
    file = F.when(of == 0, "").when(of == 1, F.concat(F.lit("/docs/"), "l_orderkey")).otherwise(F.concat(F.lit("docs/"), "l_orderkey"))
    method = F.when(F.col("l_returnflag") == "A", "structural").when(F.col("l_returnflag") == "R", "guess").otherwise("")
    noted = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("line "), "l_linenumber")).otherwise("")
    marked = rows.select(conf.provenance_error(file, method, noted, F.col("l_linenumber") - 2).alias("error"), conf.valid_location(file, F.col("l_linenumber") - 2).alias("located"))
    return marked.groupBy("error", "located").agg(F.count(F.lit(1)).alias("n"))


@query
def unstated_edges(spark, sf):
    found = derived.signals(spark, sf)
    return evidence.without_explicit(found.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence")), found.where("algorithm = 'code'"))


@query
def target_types(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "database").when(F.col("l_returnflag") == "R", "unknown").otherwise("service")
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("part-"), "l_partkey").alias("dst"), "l_orderkey", "l_linenumber", kind.alias("type"))
    return evidence.first_known_type(rows, ["l_orderkey", "l_linenumber"])


@query
def boosted_hints(spark, sf):
    kind = F.when(F.col("algorithm") == "cooccurrence", "comment_hint").otherwise(F.col("algorithm"))
    rows = derived.signals(spark, sf).where("algorithm = 'cooccurrence' or confidence > 0.85").select("src", "dst", kind.alias("signal_type"), "confidence")
    return evidence.boosted(rows).groupBy("src", "dst", "signal_type").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


@query
def registry_merged(spark, sf):
    edges = derived.part_edges(spark, sf)
    return evidence.with_registry(edges.where("n > 1"), edges.select("src", "dst", F.round(1 - F.col("confidence") * 0.4, 6).alias("confidence")))


@query
def nodes_with_stubs(spark, sf):
    nodes, edges = derived.entity_graph(spark, sf)
    types = nodes.where("id like 'nation-%1'").select("id", "component_type")
    return evidence.with_missing_nodes(nodes.where("id not like 'nation-%'"), edges, types)


@query
def merged_components(spark, sf):
    rows = derived.signals(spark, sf)
    found = lambda algorithm, column: rows.where(F.col("algorithm") == algorithm).select(F.col(column).alias("id"), F.col("evidence").alias("file"), "confidence", F.lit(algorithm).alias("origin"))
    return evidence.merged_components(found("code", "dst"), found("structural", "dst"))


# --- code and configuration text -------------------------------------------------------


@query
def code_signals(spark, sf):
    found = codescan.signals(derived.source_files(spark, sf))
    return found.select("file_path", F.col("line_number").cast("long").alias("line_number"), "target_component", "target_type", "signal_type", "language", F.round("confidence", 4).alias("confidence"), "evidence")


@query
def code_signal_kinds(spark, sf):
    return codescan.signals(derived.source_files(spark, sf)).groupBy("language", "signal_type").agg(F.count(F.lit(1)).alias("n"))


@query
def comment_hints(spark, sf):
    """Hints of comments; every second customer's name is a known component."""
    known = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.explode(F.array(*[F.concat(F.lit(p), F.col("c_custkey")) for p in ("audit-", "grid-", "nowhere-")])).alias("name"))
    found = codescan.signals(derived.source_files(spark, sf), known).where("signal_type = 'comment_hint'")
    return found.select("source_component", "file_path", F.col("line_number").cast("long").alias("line_number"), "target_component", "target_type", F.round("confidence", 4).alias("confidence"))


@query
def terraform_cross_reference(spark, sf):
    return codescan.cross_referenced(codescan.signals(derived.source_files(spark, sf)))


@query
def environment_references(spark, sf):
    return derived.source_files(spark, sf).select("path", F.explode(tx.env_names(F.col("content"))).alias("name"))


@query
def code_graph(spark, sf):
    found = codescan.signals(derived.source_files(spark, sf))
    return codescan.edges(found).select("src", "dst", "confidence", "evidence")


@query
def endpoint_pairs(spark, sf):
    lines = derived.source_files(spark, sf).select("path", F.explode(F.split("content", "\n", -1)).alias("line"))
    return lines.select("path", F.explode(tx.endpoints(F.col("line"))).alias("endpoint")).distinct()


# --- streaming -----------------------------------------------------------------------


@query
def streamed_event_counts(spark, sf):
    return ingest.windowed_counts(spark, f"{sf}/events.parquet")


@query
def streamed_edges(spark, sf):
    return ingest.streamed_best_edges(spark, derived.signals(spark, sf).select("src", "dst", "confidence"))
