"""Entities in questions: n-grams, statistics filters, votes of shuffled ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import protected_abbreviations, restored_abbreviations
from quillspark.operators.small import small

# Closed word classes that an entity's name neither is nor starts or ends with.
STOP_WORDS = (
    "a an and are as at be but by can could did do does for from had has have how if in into is it its may might must no nor not of on or "
    "our should so such than that the their them then there these they this those through to was we were what when where which while who why will with would you your"
).split()
TO_BE = "am are be been being is was were".split()
PRONOUNS = "he her hers him his i it its me mine my our ours she their theirs them they us we you your yours".split()
COMPARISONS = "better fewer greater higher larger less longer lower more most shorter smaller worse".split()


def sentences(texts: DataFrame) -> DataFrame:
    """query_idx, sent_no, tokens: sentences of (query_idx, text), split at ends that no abbreviation makes."""
    split = F.split(protected_abbreviations(F.col("text")), r"(?<=[.!?])\s+|\n+")
    rows = texts.select("query_idx", F.posexplode(split).alias("sent_no", "s"))
    words = F.filter(F.split(F.regexp_replace(restored_abbreviations(F.col("s")), r"[,;:!?()\[\]\"]", " "), r"\s+"), lambda w: w != "")
    return rows.select("query_idx", "sent_no", F.transform(words, lambda w: F.regexp_replace(w, r"^(.{2,}|[^A-Z])\.$", "$1")).alias("tokens"))


def ngrams(texts: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """query_idx, sent_no, start, k, text of every n-gram within a sentence."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)))
    rows = sentences(texts).where(F.size("tokens") > 0).withColumn("start", F.explode(starts))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(least), F.lit(most)))).where(F.col("start") + F.col("k") <= F.size("tokens"))
    return rows.select("query_idx", "sent_no", "start", "k", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("k")), " ").alias("text"))


def plausible(text: Column) -> Column:
    """Whether an n-gram may name an entity. Word classes come from closed lists and endings: no tagger is used."""
    words = F.split(F.lower(text), " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    among = lambda w, group: w.isin(*group)
    rules = [
        ~F.contains(text, F.lit("\n")),
        text.rlike("^[A-Za-z0-9].*[A-Za-z0-9]$|^[A-Za-z0-9]$"),
        F.exists(words, lambda w: ~among(w, STOP_WORDS)),
        F.length(text) >= 3,
        ~text.rlike(r"^[\d\W_]+$"),
        F.exists(words, lambda w: F.length(w) > 1),
        text.rlike(r"^[a-zA-Z0-9\-_/. ]+$"),
        ~text.endswith("."),
        ~among(first, STOP_WORDS) & ~among(last, STOP_WORDS),
        ~F.exists(words, lambda w: among(w, TO_BE)),
        ~F.exists(words, lambda w: among(w, PRONOUNS)),
        ~F.exists(words, lambda w: among(w, COMPARISONS)),
        ~last.rlike("^.{3,}(?:est|ed)$") | (F.size(words) == 1),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def without_loose_adjectives(grams: DataFrame) -> DataFrame:
    """Single words that look like adjectives go if a longer n-gram has them."""
    longer = grams.where("k > 1").select("query_idx", F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    loose = grams.where((F.col("k") == 1) & F.lower("text").rlike("(?:al|ic|ous|ive|able|ible|ary|ent|ant)$"))
    drop = loose.join(longer, (loose["query_idx"] == longer["query_idx"]) & (F.lower(loose["text"]) == longer["w"]), "left_semi").select("query_idx", "sent_no", "start", "k")
    return grams.join(drop, ["query_idx", "sent_no", "start", "k"], "left_anti")


def candidates(texts: DataFrame, least: int = 1, most: int = 5) -> DataFrame:
    """Distinct plausible n-grams of each text."""
    return without_loose_adjectives(ngrams(texts, least, most).where(plausible(F.col("text")))).select("query_idx", "k", "text").distinct()


def too_common(max_pct_paper: float | None, max_pct_chunk: float | None, max_variations: int | None) -> Column:
    limits = {"pct_paper": max_pct_paper, "pct_chunk": max_pct_chunk, "num_text_variations": max_variations}
    out = F.lit(False)
    for name, limit in limits.items():
        if limit is not None:
            out = out | F.coalesce(F.col(name) >= F.lit(limit), F.lit(False))
    return out


def high_quality(entities: DataFrame, stats: DataFrame | None, max_pct_paper: float | None = 25, max_pct_chunk: float | None = 25, max_variations: int | None = 50_000) -> DataFrame:
    """Entities (entity_name) that are not too common; unknown ones pass, and all do without statistics or limits."""
    if stats is None or max_pct_paper is max_pct_chunk is max_variations is None:
        return entities
    known = stats.select("entity_name", "pct_paper", "pct_chunk", "num_text_variations").where(too_common(max_pct_paper, max_pct_chunk, max_variations))
    return entities.join(known.select("entity_name"), "entity_name", "left_anti")


def filter_reason(max_pct_paper: float | None, max_pct_chunk: float | None, max_variations: int | None) -> Column:
    """The first rule that an entity fails, as text; null if none."""
    out = F
    rules = [
        ("pct_paper", max_pct_paper, "pct_paper %.1f >= %.1f"),
        ("pct_chunk", max_pct_chunk, "pct_chunk %.1f >= %.1f"),
        ("num_text_variations", max_variations, "num_text_variations %.1f >= %.1f"),
    ]
    for name, limit, text in rules:
        if limit is not None:
            out = out.when(F.col(name) >= F.lit(limit), F.format_string(text, F.col(name).cast("double"), F.lit(float(limit))))
    return F.lit(None).cast("string") if out is F else out.otherwise(F.lit(None))


def votes(hits: DataFrame, n_queries: int, threshold: float, known: DataFrame | None = None, at_least_one: bool = False) -> DataFrame:
    """Entities of (query_idx, entity_name, score) found by enough ensembles, those of stage 1 left out."""
    least = int(threshold * n_queries)
    least = max(1, least) if at_least_one else least
    if known is not None:
        hits = hits.join(small(known.select("entity_name").distinct()), "entity_name", "left_anti")
    best = F.max_by("query_idx", F.struct(F.col("score"), -F.col("query_idx")))
    out = hits.groupBy("entity_name").agg(
        F.count("*").alias("appearances"), best.alias("best_query"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score")
    )
    return out.where(F.col("appearances") >= least).withColumn("share", F.col("appearances") / n_queries).orderBy(F.desc("appearances"), "entity_name")


def snippets_by_category(matches: DataFrame) -> DataFrame:
    """category, snippets (a sorted set), n of (entity_name, snippet)."""
    category = F.split_part("entity_name", F.lit(":"), F.lit(1))
    out = matches.groupBy(category.alias("category")).agg(F.array_sort(F.collect_set("snippet")).alias("snippets"))
    return out.withColumn("n", F.size("snippets"))


def shares(categories: DataFrame, total: int, least: int = 3) -> DataFrame:
    """How many of ``total`` ensembles each category of at least ``least`` snippets gets: its share, one at least."""
    fit = categories.where(F.col("n") >= least)
    whole = fit.agg(F.sum("n").alias("whole"))
    return fit.crossJoin(F.broadcast(whole)).withColumn("ensembles", F.greatest(F.lit(1), F.floor(F.lit(total) * F.col("n") / F.col("whole"))).cast("int")).drop("whole")


def ensembles(categories: DataFrame, total: int, size: int, seed: int = 0) -> DataFrame:
    """query_idx-like rows (category, draw, text): seeded shuffles of each category's snippets, equal ones once."""
    rows = shares(categories, total).select("category", "snippets", F.explode(F.sequence(F.lit(1), F.col("ensembles"))).alias("draw"))
    key = lambda s: F.xxhash64(F.lit(seed), F.col("category"), F.col("draw"), s)
    order = F.transform(F.array_sort(F.transform("snippets", lambda s: F.struct(key(s).alias("k"), s.alias("s")))), lambda x: x.s)
    return rows.select("category", "draw", F.array_join(F.slice(order, 1, size), " ").alias("text")).groupBy("category", "text").agg(F.min("draw").alias("draw"))

