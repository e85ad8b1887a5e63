"""Citations: markers in answers to numbered footnotes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import replace_by, split_grouped_handles, without_leading_headers

_MARK = r"\[(C\d+|chunk-[a-f0-9]{40}-\d+)\]"


def labels(cited: DataFrame) -> DataFrame:
    """label of each cited (answer_id, pos, chunk_id, paper_id): papers in order of first mention; ``P``, or ``P-c`` where several chunks of a paper are cited."""
    first = cited.groupBy("answer_id", "paper_id", "chunk_id").agg(F.min("pos").alias("pos"))
    paper = Window.partitionBy("answer_id", "paper_id")
    rows = first.withColumn("paper_pos", F.min("pos").over(paper)).withColumn("n", F.count("*").over(paper))
    p = F.dense_rank().over(Window.partitionBy("answer_id").orderBy("paper_pos"))
    c = F.row_number().over(paper.orderBy("pos"))
    label = F.when(F.col("n") == 1, p.cast("string")).otherwise(F.concat_ws("-", p.cast("string"), c.cast("string")))
    return rows.select("answer_id", "paper_id", "chunk_id", "pos", label.alias("label"))


def label_key(label: Column) -> Column:
    """Sorts 1, 1-2, 1-10, 2."""
    return F.transform(F.split(label, "-"), lambda x: x.cast("int"))


def tidy_markers(text: Column) -> Column:
    """Markers in one form: half-width brackets around markers only, one handle a bracket, upper-case C, lower-case chunk ids."""
    handle = r"(?:[Cc]\d+(?:\s*[,;，、]\s*[Cc]\d+)*|[Cc][Hh][Uu][Nn][Kk]-[a-fA-F0-9]{40}-\d+)"
    t = F.regexp_replace(text, rf"[【［\[]\s*({handle})\s*[】］\]]", "[$1]")
    t = split_grouped_handles(F.regexp_replace(t, r"(?<=\d)\s*[，、;]\s*(?=[Cc]\d+)", ", "))
    t = F.regexp_replace(t, r"\[c(\d+)\]", "[C$1]")
    return replace_by(r"(?i)\[chunk-[a-f0-9]{40}-\d+\]", lambda m: m.group(0).lower())(t)


def names(authors: Column) -> Column:
    """Author names from JSON: a string, a list of strings, or a list of objects with name, or family and given."""
    v = F.try_parse_json(authors)
    strings = F.try_variant_get(v, "$", "array<string>")
    people = F.try_variant_get(v, "$", "array<struct<name:string,given:string,family:string>>")
    named = F.transform(people, lambda p: F.coalesce(p["name"], F.nullif(F.concat_ws(" ", p["family"], p["given"]), F.lit(""))))
    one = F.array(F.coalesce(F.try_variant_get(v, "$", "string"), authors))
    return F.filter(F.when(F.exists(named, lambda x: x.isNotNull()), named).when(strings.isNotNull(), strings).otherwise(one), lambda x: x.isNotNull() & (x != ""))


def journal_name(journal: Column) -> Column:
    v = F.try_parse_json(journal)
    return F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.try_variant_get(v, "$.name", "string").isNull() & ~journal.startswith("{"), journal))


def definition(label: Column, authors: Column, year: Column, title: Column, journal: Column, doi: Column, content: Column) -> Column:
    """A footnote: who and when, title, journal and DOI as far as there are any, then the passage quoted, four blanks in."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    who = some(F.concat_ws(" ", some(F.array_join(authors, ", ")), F.concat(F.lit("("), some(year), F.lit(")"))))
    head = F.concat_ws(". ", who, F.regexp_replace(some(title), r"\.+$", ""))
    head = F.concat(head, F.when(some(title).isNotNull(), F.lit(".")).otherwise(F.lit("")))
    head = F.concat(head, F.coalesce(F.concat(F.lit(" *"), some(journal), F.lit("*")), F.lit("")), F.coalesce(F.concat(F.lit(". https://doi.org/"), some(doi)), F.lit("")))
    lines = F.transform(F.split(without_leading_headers(content), "\n"), lambda x: F.when(F.trim(x) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x)))
    quoted = F.array_join(lines, "\n    ")
    return F.concat(F.lit("[^"), label, F.lit("]: "), F.when(head != "", F.concat(head, F.lit("\n    "))).otherwise(F.lit("")), quoted)


_RUN = r"\[\^[\d-]+\](?:[ \t]*\[\^[\d-]+\])+"


def _sorted_run(m: re.Match) -> str:
    marks = dict.fromkeys(re.findall(r"\[\^[\d-]+\]", m.group(0)))
    return "".join(sorted(marks, key=lambda x: [int(n) for n in x[2:-1].split("-")]))


def resolved(answers: DataFrame, refs: DataFrame, papers: DataFrame) -> DataFrame:
    """answer_id, text: markers become footnotes, unknown ones go, definitions follow in label order.

    answers (answer_id, text); refs (answer_id, id, handle, content); papers (paper_id, title,
    authors, year, journal, doi). Texts are cut into literals and markers, markers joined, and
    the text put together again, so no driver-side substitution takes place.
    """
    tidy = answers.select("answer_id", tidy_markers(F.col("text")).alias("text"))
    literal, mark = F.split("text", _MARK), F.regexp_extract_all("text", F.lit(_MARK), 1)
    parts = tidy.select("answer_id", F.posexplode(F.arrays_zip(literal.alias("lit"), mark.alias("mark"))).alias("pos", "p")).select("answer_id", "pos", F.coalesce("p.lit", F.lit("")).alias("lit"), "p.mark")
    known = refs.where(F.col("id").isNotNull()).select("answer_id", "id", "handle", "content")
    by = known.select("answer_id", F.col("handle").alias("mark"), "id").where("mark is not null").unionByName(known.select("answer_id", F.col("id").alias("mark"), "id")).distinct()
    paper = F.regexp_extract("id", r"^chunk-([a-f0-9]{40})-\d+$", 1)
    hits = parts.join(by, ["answer_id", "mark"]).withColumn("paper_id", paper).join(papers.select("paper_id"), "paper_id", "left_semi")
    numbered = labels(hits.select("answer_id", "pos", F.col("id").alias("chunk_id"), "paper_id"))
    marked = hits.select("answer_id", "pos", F.col("id").alias("chunk_id")).join(numbered.select("answer_id", "chunk_id", "label"), ["answer_id", "chunk_id"]).select("answer_id", "pos", "label")
    whole = parts.join(marked, ["answer_id", "pos"], "left")
    piece = F.concat(F.col("lit"), F.when(F.col("label").isNotNull(), F.concat(F.lit("[^"), F.col("label"), F.lit("]"))).otherwise(F.lit("")))
    body = whole.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x.t), "").alias("body"))
    body = body.withColumn("body", replace_by(_RUN, _sorted_run)(F.col("body")))
    notes = numbered.join(papers, "paper_id").join(known.select("answer_id", F.col("id").alias("chunk_id"), "content").distinct(), ["answer_id", "chunk_id"])
    notes = notes.withColumn("note", definition(F.col("label"), F.col("authors"), F.col("year"), F.col("title"), F.col("journal"), F.col("doi"), F.col("content")))
    tail = notes.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(label_key(F.col("label")).alias("k"), F.col("note").alias("t")))), lambda x: x.t), "\n\n").alias("tail"))
    out = body.join(tail, "answer_id", "left")
    return out.select("answer_id", F.when(F.col("tail").isNull(), F.col("body")).otherwise(F.concat(F.rtrim("body"), F.lit("\n\n"), F.col("tail"))).alias("text"))
