"""Rules restated in plain Python on small rows, and properties that hold on any rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.models import TextGen, hashed_embedding
from quillspark.operators import context, entity, fusion, graph, keyword, rerank, select, vector
from quillspark.plans import modes
from quillspark.sources import sinks, stores


def ids(df, c="chunk_id"):
    return [r[c] for r in df.collect()]


def test_cosine_of_orthogonal_opposite_equal_and_zero(spark):
    v = spark.createDataFrame([("o", [0.0, 1.0]), ("m", [-2.0, 0.0]), ("e", [3.0, 0.0]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_idx int, query_vector array<float>")
    got = {r.id: r.score for r in vector.scored(v, q).collect()}
    assert (got["o"], got["m"], got["e"]) == (0, -1, 1) and got["z"] != got["z"]


def test_threshold_comes_after_the_limit(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id int, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_idx int, query_vector array<float>")
    assert len(ids(vector.top_k(v, q, 3), "id")) == 3
    assert len(ids(vector.top_k(v, q, 3, threshold=0.99), "id")) == sum(i / (i * i + 1) ** 0.5 >= 0.99 for i in (9, 8, 7))


def test_max_over_queries_takes_the_first_of_ties(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, 1), (0, "a", 0.5, 2), (2, "a", 0.4, 1)], "query_idx int, id string, score double, rank int")
    (r,) = vector.best_per_id(hits).collect()
    assert (r.query_idx, r.query_rank) == (0, 2)


def weighted(lists: list[list], most: int, least: int) -> list:
    n = len(lists)
    if n == 1:
        return lists[0][:most]
    quota = [round(most - i / (n - 1) * (most - least)) for i in range(n)]
    taken = [x[:q] for x, q in zip(lists, quota, strict=True)]
    spare = sum(max(0, q - len(x)) for x, q in zip(lists, quota, strict=True))
    left = [c for x, q in zip(lists, quota, strict=True) for c in x[q:]]
    return [c for t in taken for c in t] + left[:spare]


@pytest.mark.parametrize("sizes", [[7], [0, 9, 9], [1, 1, 9, 9, 9, 2, 2], [5] * 7])
def test_weighted_pick(spark, sizes):
    lists = [[f"{e}-{c}" for c in range(n)] for e, n in enumerate(sizes)]
    rows = [(e, c, x) for e, xs in enumerate(lists) for c, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "entity_pos int, chunk_pos int, chunk_id string")
    have = [x for x in lists if x]  # entities without passages have no rows
    assert sorted(ids(select.weighted_pick(df, 5, 2))) == sorted(weighted(have, 5, 2))


def test_reciprocal_rank_is_symmetric_and_tags(spark):
    rows = [(0, 1, "a", "elasticsearch"), (0, 2, "b", "elasticsearch"), (1, 1, "b", "milvus"), (1, 2, "c", "milvus")]
    a = {r.chunk_id: (round(r.rrf, 12), r.tag) for r in fusion.reciprocal_rank(spark.createDataFrame(rows, "list_idx int, rank int, chunk_id string, source string")).collect()}
    b = {r.chunk_id: (round(r.rrf, 12), r.tag) for r in fusion.reciprocal_rank(spark.createDataFrame([(1 - r[0], *r[1:]) for r in rows], "list_idx int, rank int, chunk_id string, source string")).collect()}
    assert a == b == {"a": (round(1 / 61, 12), "es_only"), "b": (round(1 / 62 + 1 / 61, 12), "hybrid_overlap"), "c": (round(1 / 62, 12), "milvus_only")}


def test_balanced_cut(spark):
    rows = [(f"k{i}", "kg", 1.0 - i / 100) for i in range(9)] + [(f"e{i}", "elasticsearch", 1.0 - i / 100) for i in range(2)] + [(f"m{i}", "milvus", 1.0 - i / 100) for i in range(9)]
    rows += [("x", s, 2.0) for s in ("kg", "elasticsearch", "milvus")] + [("y", s, 1.5) for s in ("kg", "milvus")]
    df = spark.createDataFrame(rows, "chunk_id string, source string, score double")
    got = ids(fusion.balanced_cut(df, 12).orderBy("pos"))
    assert got[:2] == ["x", "y"] and len(got) == len(set(got)) == 12
    # ten left: three a source, elasticsearch has two, the rest goes to kg
    assert sum(c[0] == "k" for c in got) == 5 and sum(c[0] == "e" for c in got) == 2 and sum(c[0] == "m" for c in got) == 3
    assert set(ids(fusion.balanced_cut(df, 100))) == {r[0] for r in rows}
    assert ids(fusion.balanced_cut(df.limit(0), 5)) == []


def test_budget_cascade_and_expansion(spark):
    rows = spark.createDataFrame([(0, 5), (1, 5), (2, 0), (3, 1), (4, 9)], "pos int, tokens int")
    assert ids(rerank.token_budget(rows, 10), "pos") == [0, 1, 2] and ids(rerank.token_budget(rows, 0), "pos") == []
    q = spark.createDataFrame([(0, "red fox"), (1, "blue bird")], "query_idx int, text string")
    docs = spark.createDataFrame([("a", "p", "the red fox"), ("b", "p", "a blue sky"), ("c", "r", "nothing here"), ("d", "p", "red")], "chunk_id string, paper_id string, content string")
    one, two = rerank.cascade(docs, q, stage1_min=0.5, stage2_min=0.5)
    assert set(ids(one)) == {"a", "b", "d"} and set(ids(two)) <= set(ids(one))
    out = {r.chunk_id: r.origin for r in rerank.expand_documents(two.where("chunk_id = 'a'").select("chunk_id", "score"), docs, q, min_score=0.1).collect()}
    assert out == {"a": "kept", "b": "expanded", "d": "expanded"}


def test_graph_with_loops_isolated_nodes_and_band(spark):
    e = spark.createDataFrame([("a", "b", 1000), ("c", "a", 999), ("a", "a", 5), ("b", "d", 50_000), ("b", "f", 50_001)], "src string, dst string, weight long")
    n = spark.createDataFrame([(x, "T", x) for x in "abcdfz"], "entity_id string, entity_type string, description string")
    want = spark.createDataFrame([("a",), ("z",), ("b",)], "entity_id string")
    assert {r.entity_id: r.degree for r in graph.degrees(e, want).collect()} == {"a": 3, "b": 3, "z": 0}
    seeds = spark.createDataFrame([("a",)], "entity_id string")
    assert [(r.entity_id, r.hop) for r in graph.expand(seeds, e, n, 2, 0.1, 20).collect()] == [("b", "neo4j_hop_1"), ("d", "neo4j_hop_2")]
    assert graph.least_weight(0.1) == 1000 and graph.least_weight(7) == 7


def test_statistics_filter(spark):
    s = stores.with_variations(spark.createDataFrame([("x", 25.0, 1.0, "a||b"), ("y", 24.9, 1.0, None), ("w", 1.0, 30.0, " ")], "entity_name string, pct_paper double, pct_chunk double, all_extracted_text string"))
    assert {r.entity_name: r.num_text_variations for r in s.collect()} == {"x": 2, "y": 0, "w": 0}
    names = spark.createDataFrame([("x",), ("y",), ("w",), ("unknown",)], "entity_name string")
    assert set(ids(entity.high_quality(names, s), "entity_name")) == {"y", "unknown"}
    assert set(ids(entity.high_quality(names, s, None, None, None), "entity_name")) == {"x", "y", "w", "unknown"}
    assert [r.f for r in s.where("entity_name = 'w'").select(entity.filter_reason(25, 25, 5).alias("f")).collect()] == ["pct_chunk 30.0 >= 25.0"]


def test_votes_at_the_threshold(spark):
    hits = spark.createDataFrame([(i, "a", 0.5) for i in range(5)] + [(0, "b", 0.9), (1, "b", 0.9)], "query_idx int, entity_name string, score double")
    assert ids(entity.votes(hits, 20, 0.25), "entity_name") == ["a"]
    assert {r.entity_name: r.best_query for r in entity.votes(hits, 20, 0.0).collect()} == {"a": 0, "b": 0}


def test_ngrams_keep_to_sentences_and_names(spark):
    df = spark.createDataFrame([(0, "The E. coli strain binds BRCA1. It is the best")], "query_idx int, text string")
    got = set(ids(entity.candidates(df), "text"))
    assert {"E. coli strain", "BRCA1", "strain binds BRCA1"} <= got
    assert not {"The", "It is", "BRCA1 It", "the best"} & got


def test_context_handles_go_on_and_hide(spark):
    rows = [(f"c{i:02d}", 0.9 - i * 0.01 if i < 6 else 0.4 - i * 0.001, "t", "p") for i in range(20)]
    shown = context.split_and_handles(spark.createDataFrame(rows, "chunk_id string, rerank_score double, content string, paper_id string"), 0.5)
    got = {r.chunk_id: (r.section, r.handle) for r in shown.collect()}
    assert [got[f"c{i:02d}"] for i in range(6)] == [("good", f"C{i + 1}") for i in range(6)]
    assert sum(h is not None for _, h in got.values()) == 16 and sum(s == "hidden" for s, _ in got.values()) == 4


TEXTS = [
    ("mongodb://u:p@h/x and a@b.c", X.redacted, "mongodb://***@h/x and a@b.c"),
    ("http://h/x", X.redacted, "http://h/x"),
    ("<think>a</think> <answer> yes </answer> z", X.answer_of, "yes"),
    ("<answer>open", X.answer_of, "open"),
    ("no tags", X.answer_of, "no tags"),
    ("x</think>\n rest", X.without_thinking, "rest"),
    ("a &amp; b\x00\x85", X.sanitised, "a & b"),
    ("<p>a<br>b</p>", X.without_tags, "a b"),
    ("ＡＢ１", X.normalised_name, "AB1"),
    ('"quoted"', X.normalised_name, "quoted"),
    ("12", X.normalised_name, ""),
    ("# Head\n\ntext\n## Sub\nmore", X.without_leading_headers, "text\nSub\nmore"),
    ("# Only", X.without_leading_headers, "# Only"),
    ("[C1, C2; C3] [x, y]", X.split_grouped_handles, "[C1][C2][C3] [x, y]"),
    ('{"text": "t", "output": "o"}', X.response_text, "t"),
    ("plain", X.response_text, "plain"),
    ("CALL: query_kg now", X.tool_call, "query_kg"),
    ("```json\n{}\n```", X.without_fences, "{}"),
    ('so {"a": 1} end', X.rescued_object, '{"a": 1}'),
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_text_functions(spark, i):
    text, f, want = TEXTS[i]
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(f(F.col("t")).alias("x")).first().x == want


def test_string_lists(spark):
    raw = ['["a", "b"]', '{"queries": ["q"]}', '{"other": ["o"]}', '```\n["f"]\n```', '"one"', "", "{broken", '{"n": 3}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = [r.x for r in df.select("i", X.string_list(F.col("r")).alias("x")).orderBy("i").collect()]
    assert got[:4] == [["a", "b"], ["q"], ["o"], ["f"]] and got[5:] == [None, None, None]


def test_caches(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None)], "k string, v string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    entries = sinks.cache_rows(rows, "k", "v", now, 60)
    assert ids(sinks.new_entries(entries, entries.limit(0)), "key") == ["a"]
    assert ids(sinks.new_entries(entries, entries), "key") == []
    assert len(ids(stores.latest_valid(entries, F.lit("2024-01-01 00:00:59").cast("timestamp")), "key")) == 3
    assert ids(stores.latest_valid(entries, F.lit("2024-01-01 00:01:00").cast("timestamp")), "key") == []


def test_scans_and_config(spark, tmp_path):
    keys = spark.createDataFrame([("ns:a.1",), ("ns:ab1",), ("other:a.1",)], "key string")
    assert ids(stores.scan_keys(keys, "a.*", 10, "ns"), "key") == ["a.1"]
    ini = tmp_path / "c.ini"
    ini.write_text("[s]\nport = 1\n")
    names = {"PORT": ("s", "port", int), "HOST": ("s", "host", str)}
    assert stores.load_config(str(ini), names, {"PORT": "x", "HOST": ""}) == {"s": {"port": "1"}}
    assert stores.load_config(str(ini), names, {"PORT": "7", "HOST": "h"}) == {"s": {"port": 7, "host": "h"}}
    tsv = tmp_path / "s.tsv"
    tsv.write_text("entity_name\tpct_paper\tpct_chunk\nx\t1.5\t2\n")
    assert stores.load_statistics(spark, str(tsv)).first().pct_paper == 1.5
    tsv.write_text("entity_name\nx\n")
    with pytest.raises(ValueError, match="missing"):
        stores.load_statistics(spark, str(tsv))
    assert stores.load_json(spark, str(tmp_path / "none.json")) is None


def test_search_is_the_same_for_any_order_of_rows(spark):
    r = random.Random(4)
    rows = [(f"c{i}", " ".join(r.choices(["red", "fox", "blue", "sky", "tree"], k=8))) for i in range(50)]
    q = spark.createDataFrame([(0, "red fox"), (1, "tree")], "query_idx int, text string")
    a, b = ([(x.query_idx, x.chunk_id) for x in keyword.search(spark.createDataFrame(rs, "chunk_id string, content string"), q, 5).orderBy("query_idx", "rank").collect()] for rs in (rows, rows[::-1]))
    assert a == b


def test_modes(spark):
    chunks = [(f"chunk-{'a' * 40}-{i:06d}", "a" * 40, i, t) for i, t in enumerate(["the red fox runs", "a blue bird sings", "red birds and foxes"])]
    c = spark.createDataFrame(chunks, "chunk_id string, paper_id string, chunk_no int, content string")
    t = {
        "chunks": c,
        "papers": spark.createDataFrame([("a" * 40, "T", ["A"], "2020", "J", None)], "paper_id string, title string, authors array<string>, year string, journal string, doi string"),
        "chunk_vectors": c.select(F.col("chunk_id").alias("id"), hashed_embedding(F.col("content")).alias("vector")),
        "entities": spark.createDataFrame([("GENE:fox", "Gene", "fox")], "entity_id string, entity_type string, description string"),
        "nodes": spark.createDataFrame([("GENE:fox", "Gene", "fox"), ("GENE:bird", "Gene", "bird")], "entity_id string, entity_type string, description string"),
        "edges": spark.createDataFrame([("GENE:fox", "GENE:bird", 2000)], "src string, dst string, weight long"),
        "entity_sources": spark.createDataFrame([("GENE:fox", chunks[0][0]), ("GENE:bird", chunks[1][0])], "entity_id string, chunk_id string"),
        "entity_stats": None,
    }
    gen = TextGen(answer=lambda prompt: "It runs [C1]." if "red fox" in prompt else "nothing")
    for mode in ("naive", "hybrid", "mix"):
        p = modes.QueryParam(mode=mode, stage1_min_score=0.1, stage2_min_score=0.1, rerank_min_score=0.1)
        stages = modes.ask(spark, t, "red fox", p, gen)
        assert {"scored1", "scored2", "shown", "references"} <= set(stages)
        assert chunks[0][0] in ids(stages["references"], "id")
    assert modes.respond(spark, t, "red fox", p, gen).first().text.startswith("It runs [^1].\n\n[^1]: A (2020). T. *J*")
    with pytest.raises(ValueError, match="unknown mode"):
        modes.ask(spark, t, "q", modes.QueryParam(mode="nope"))


def test_passages_by_vector_and_traces(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillspark.functions.models import hashed_embedding
    from quillspark.plans import modes
    from quillspark.plans.params import QueryParam
    from quillspark.sources.sinks import Trace

    texts = [("a", "river stone"), ("b", "window letter"), ("c", "river letter"), ("d", "far away")]
    vectors = spark.createDataFrame(texts, "id string, t string").select("id", hashed_embedding(F.col("t")).alias("vector"))
    tables = {"chunk_vectors": vectors, "entity_sources": spark.createDataFrame([("E", "a"), ("E", "b"), ("E", "c"), ("F", "d")], "entity_id string, chunk_id string")}
    entities = spark.createDataFrame([("E", 3)], "entity_id string, degree int")
    question = spark.createDataFrame([(0, "river stone")], "query_idx int, text string")
    p = QueryParam(kg_pick_method="VECTOR", kg_chunk_top_k=2)
    got = [r.chunk_id for r in modes.own_passages(tables, entities, p, question, None).orderBy(F.desc("score")).collect()]
    assert got[0] == "a" and len(got) == 2 and "d" not in got
    with pytest.raises(ValueError, match="pick"):
        modes.own_passages(tables, entities, QueryParam(kg_pick_method="none"), question, None)
    trace = Trace("q1")
    modes.ask(spark, tables, "What?", QueryParam(mode="bypass"), trace=trace)
    trace.write(str(tmp_path))
    assert spark.read.json(f"{tmp_path}/query_id=q1/question").count() == 1


def test_relation_passages_shuffles_its_sources_once(spark, tmp_path):
    """Wide hubs: each part is in every order, so pairs times passages of an end would be many rows."""
    import re

    from quillspark.operators import select
    from quillspark.plans import named

    lines = [(o, p) for o in range(4) for p in range(8, 13)] + [(0, 9), (7, 9), (7, 10), (8, None), (None, 9), (None, 10)]  # 9 twice; null keys
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = named.queries()["relation_passages"](spark, str(tmp_path))
    own = {(f"PART:{p}", f"ORDER:{o}") for o, p in lines if o is not None and p is not None}
    want = sorted((a, b, o) for a, o in own for b, q in own if o == q and a < b)  # PART:10 comes before PART:9
    assert sorted(tuple(r) for r in df.select("src", "dst", "chunk_id").collect()) == want
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert not re.search(r"hashpartitioning\((src|dst)", plan), plan  # no pair is shuffled
    pairs = spark.createDataFrame([("PART:9", "PART:8"), ("PART:9", "PART:8")], "src string, dst string")
    sources = spark.createDataFrame(sorted(own), "entity_id string, chunk_id string")
    assert sorted(r.chunk_id for r in select.relation_sources(pairs, sources).collect()) == [f"ORDER:{o}" for o in range(4)]
