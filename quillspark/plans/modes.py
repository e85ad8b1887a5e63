"""Query modes: a question in, one lazy relation a stage out.

``tables`` has chunks (chunk_id, paper_id, chunk_no, content), papers, chunk_vectors (id,
vector), entities (entity_id, entity_type, description), edges (src, dst, weight), nodes,
entity_sources (entity_id, chunk_id) and entity_stats or None. Ids travel, contents join last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.models import TextGen, hashed_embedding, token_count
from quillspark.operators import cite, context, entity, fusion, graph, keyword, rerank, select, vector
from quillspark.operators.small import settled, small
from quillspark.plans.params import QueryParam
from quillspark.sources.sinks import Trace

PICKS = ("ENTITY_OVERLAP", "WEIGHT", "VECTOR")
MODES = ("naive", "local", "global", "hybrid", "mix", "bypass")


def match_entities(grams: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, entity_name, ngrams: entities whose description an n-gram of the question equals, case aside."""
    hits = small(grams.select("query_idx", F.lower("text").alias("key"), "text").distinct()).join(entities.withColumn("key", F.lower("description")), "key")
    return hits.groupBy("entity_id").agg(F.array_sort(F.collect_set("text")).alias("ngrams")).withColumn("entity_name", F.col("entity_id"))


def vector_hits(tables: dict, queries: DataFrame, per_query: int, total: int) -> DataFrame:
    asked = queries.select("query_idx", hashed_embedding(F.col("text")).alias("query_vector"))
    return vector.candidates(tables["chunk_vectors"], asked, per_query, total).select(F.col("id").alias("chunk_id"), "score")


def shown_stages(stages: dict, tables: dict, ids: DataFrame, queries: DataFrame, p: QueryParam) -> dict:
    """Contents, cascade, expansion, token budget, handles, references and the prompt's passages."""
    docs = tables["chunks"].join(small(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")
    one, two = rerank.cascade(docs, queries, stage1_top=p.stage1_top_k, stage1_min=p.stage1_min_score, stage2_min=p.stage2_min_score, how=p.score_aggregation)
    stages["scored1"], stages["scored2"] = one, two
    kept = settled(two.select("chunk_id", "score"))
    if p.expand_documents:
        kept = rerank.expand_documents(kept, tables["chunks"], queries, min_score=p.rerank_min_score)
        kept = settled(kept)
    stages["expanded"] = kept
    top = kept.orderBy(F.desc("score"), "chunk_id").limit(p.chunk_top_k)
    full = tables["chunks"].join(F.broadcast(top), "chunk_id").withColumn("tokens", token_count(F.col("content")))
    full = full.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    fit = rerank.token_budget(full, p.max_total_tokens).withColumnRenamed("score", "rerank_score")
    stages["shown"] = context.split_and_handles(fit, p.rerank_min_score)
    stages["references"] = context.references(stages["shown"])
    stages["passages"] = context.blocks(stages["shown"])
    return stages


def ask(spark: SparkSession, tables: dict, question: str, p: QueryParam | None = None, gen: TextGen | None = None, trace: Trace | None = None) -> dict[str, DataFrame]:
    """The stages of a question by name; ``shown`` and ``references`` are what an answer is made from. A trace is given each of them."""
    stages = _ask(spark, tables, question, p, gen)
    for name, df in stages.items() if trace else ():
        trace.log(name, df)
    return stages


def _ask(spark: SparkSession, tables: dict, question: str, p: QueryParam | None, gen: TextGen | None) -> dict[str, DataFrame]:
    p, gen = p or QueryParam(), gen or TextGen()
    if p.mode not in MODES:
        raise ValueError(f"unknown mode {p.mode!r}")
    stages: dict[str, DataFrame] = {"question": gen.frame(spark, [question])}
    if p.mode == "bypass":
        return stages
    texts = gen.expanded(question, p.num_query_expansions) + gen.guesses(question, p.max_hyde)
    queries = stages["queries"] = gen.frame(spark, texts)
    judged = gen.frame(spark, gen.parts(question, p.max_subqueries))
    vec = kw = kg = None
    if p.mode in ("naive", "mix"):
        vec = stages["vector"] = settled(vector_hits(tables, queries, p.candidate_top_k, p.milvus_top_k))
    if p.mode == "naive":
        return shown_stages(stages, tables, vec, judged, p)
    if p.mode == "mix":
        kw = stages["keyword"] = settled(keyword.search_many(tables["chunks"], queries, p.es_top_k_per_query, p.es_top_k))
    grams = entity.candidates(stages["question"], p.ngram_min, p.ngram_max)
    found = entity.high_quality(match_entities(grams, tables["entities"]), tables.get("entity_stats"), p.max_pct_paper, p.max_pct_chunk, p.max_text_variations)
    stages["entities1"] = found = settled(found)
    hops = settled(graph.expand(found, tables["edges"], tables["nodes"], p.graph_hops, p.min_paper_support, p.graph_per_hop))
    stages["hop1"] = hops
    ids = found.select("entity_id").union(hops.select("entity_id")).distinct()
    stages["entities"] = settled(graph.node_data(ids, tables["edges"], tables["entities"], tables["nodes"], p.top_k))
    if p.entities_only:
        return stages
    stages["edges"] = settled(graph.edges_of(tables["edges"], stages["entities"], p.top_k))
    kg = own_passages(tables, stages["entities"], p, stages["question"], vec)
    if p.mode in ("global", "hybrid"):
        ends = graph.entities_of(stages["edges"], p.top_k)
        more = select.relation_sources(stages["edges"], tables["entity_sources"]).groupBy("chunk_id").agg(F.count("*").cast("double").alias("score"))
        both = [more] if p.mode == "global" else [kg, more]
        stages["edge_entities"] = ends
        kg = both[0] if len(both) == 1 else both[0].unionByName(both[1]).groupBy("chunk_id").agg(F.max("score").alias("score"))
    stages["kg"] = kg = settled(kg)
    rows = kg.select("chunk_id", F.lit("kg").alias("source"), "score")
    if p.mode == "mix":
        rows = rows.unionByName(kw.select("chunk_id", F.lit("elasticsearch").alias("source"), "score")).unionByName(vec.select("chunk_id", F.lit("milvus").alias("source"), "score"))
    stages["merged"] = fusion.source_sets(rows)
    stages["selected"] = settled(fusion.balanced_cut(rows, p.merged_top_k))
    return shown_stages(stages, tables, stages["selected"], judged, p)


def own_passages(tables: dict, entities: DataFrame, p: QueryParam, question: DataFrame, hits: DataFrame | None) -> DataFrame:
    """chunk_id, score of the entities' passages by the chosen method; ``hits`` of a vector search narrow down what VECTOR compares."""
    if p.kg_pick_method not in PICKS:
        raise ValueError(f"unknown way to pick passages {p.kg_pick_method!r}")
    if p.kg_pick_method == "VECTOR":
        own = tables["entity_sources"].join(small(entities.select("entity_id")), "entity_id", "left_semi").select(F.col("chunk_id").alias("id"))
        asked = question.select(hashed_embedding(F.col("text")).alias("query_vector"))
        near = hits.select(F.col("chunk_id").alias("id"), "score") if hits is not None else None
        picked = select.vector_pick(own, tables["chunk_vectors"], asked, near, p.kg_chunk_top_k, p.high_similarity_threshold, p.min_intersection_size)
        return picked.select(F.col("id").alias("chunk_id"), "score")
    if p.kg_pick_method == "WEIGHT":
        order = entities.select("entity_id", (F.row_number().over(Window.orderBy(F.desc("degree"), "entity_id")) - 1).alias("entity_pos"))
        lists = tables["entity_sources"].join(F.broadcast(order), "entity_id").withColumn("chunk_pos", F.row_number().over(Window.partitionBy("entity_id").orderBy("chunk_id")))
        taken = select.weighted_pick(lists, p.max_related_chunks, p.min_related_chunks)
        return taken.groupBy("chunk_id").agg((1.0 / (1 + F.min("entity_pos"))).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(p.kg_chunk_top_k)
    picked = select.overlap_pick(tables["entity_sources"], entities, tables["chunks"], p.kg_chunk_top_k)
    return picked.select("chunk_id", F.col("overlap").cast("double").alias("score"))


def respond(spark: SparkSession, tables: dict, question: str, p: QueryParam | None = None, gen: TextGen | None = None) -> DataFrame:
    """One row: the generated answer with its citations resolved."""
    gen = gen or TextGen()
    stages = ask(spark, tables, question, p, gen)
    parts = {r["section"]: r["text"] for r in stages["passages"].collect()} if "passages" in stages else {}
    prompt = "\n\n".join([question, parts.get("good", ""), parts.get("maybe", "")]).strip()
    answer = spark.createDataFrame([(0, gen.answer(prompt))], "answer_id int, text string")
    if "references" not in stages:
        return answer
    refs = stages["references"].select(F.lit(0).alias("answer_id"), "id", "handle", "content")
    papers = tables["papers"]
    papers = papers if "doi" in papers.columns else papers.withColumn("doi", F.lit(None).cast("string"))
    return cite.resolved(answer, refs, papers)
