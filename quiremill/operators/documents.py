"""Operators on the lines, blocks and pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiremill.functions.text import count_of, letters

SENTENCE_END = r"[.!?:;…»”\"')\]]\s*$"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def pages(docs: DataFrame, size: int = 5) -> DataFrame:
    """Lines with page_no: every `size` lines make a page."""
    return lines(docs).withColumn("page_no", F.floor(F.col("line_no") / size).cast("long"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, word: lower-cased letter runs, one row each."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("word"))


def lexicon(docs: DataFrame, least: int = 3) -> DataFrame:
    """word, n of the words that `least` documents use: what counts as valid without an analyser."""
    return tokens(docs).distinct().groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def merge_broken(lines_: Column) -> Column:
    """Paragraphs from an array of lines: a line joins the one before if that, as merged so far, has no end mark, is longer than
    40 characters, and the line starts in lower case. The condition looks at what has been merged, so it is a fold."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(a: Column, x: Column) -> Column:
        join = a["cur"].isNotNull() & ~a["cur"].rlike(SENTENCE_END) & (F.length(a["cur"]) > 40) & x.rlike(r"^\p{Ll}")
        done = F.when(join | a["cur"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["cur"]))
        return F.struct(done.alias("done"), F.when(join, F.concat(a["cur"], F.lit(" "), x)).otherwise(x).alias("cur"))

    return F.aggregate(lines_, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def pack(lines_: Column, size: int = 3000) -> Column:
    """Greedy chunks of an array of lines: a chunk closes when the next line would take it over `size`; each line counts one more for
    its end. Lines without a letter or digit are left out. Returns the chunks' lines joined."""
    kept = F.filter(lines_, lambda x: x.rlike(r"[\p{L}\p{N}]"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["cur"]) > 0) & (a["n"] + F.length(x) > size)
        return F.struct(
            F.when(full, F.array_append(a["done"], F.array_join(a["cur"], "\n"))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.array_append(a["cur"], x)).alias("cur"),
            F.when(full, F.length(x) + 1).otherwise(a["n"] + F.length(x) + 1).alias("n"),
        )

    return F.aggregate(kept, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["done"], F.array_join(a["cur"], "\n"))).otherwise(a["done"]))


def pack_flagged(lines_: Column, size: int = 15_000) -> Column:
    """Greedy chunks of an array of structs (text, flag): a chunk also closes where the flag changes. Structs (flag, text) come back."""
    start = F.struct(F.array().cast("array<struct<flag:boolean,text:string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("flag"))

    def closed(a: Column) -> Column:
        return F.array_append(a["done"], F.struct(a["flag"].alias("flag"), F.array_join(a["cur"], "\n").alias("text")))

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["cur"]) > 0) & ((a["n"] + F.length(x["text"]) > size) | (x["flag"] != a["flag"]))
        return F.struct(
            F.when(full, closed(a)).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(x["text"])).otherwise(F.array_append(a["cur"], x["text"])).alias("cur"),
            F.when(full, F.length(x["text"]) + 1).otherwise(a["n"] + F.length(x["text"]) + 1).alias("n"),
            x["flag"].alias("flag"),
        )

    return F.aggregate(lines_, start, step, lambda a: F.when(F.size(a["cur"]) > 0, closed(a)).otherwise(a["done"]))


def repeated_edges(paged: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """doc_id, key, n, pages: first or last lines of pages that, without digits, come back on enough pages."""
    w = Window.partitionBy("doc_id", "page_no")
    edge = paged.withColumn("lo", F.min("line_no").over(w)).withColumn("hi", F.max("line_no").over(w)).filter("line_no = lo OR line_no = hi")
    key = F.trim(F.regexp_replace("line", "[0-9]+", ""))
    counted = edge.filter(F.length("line") < 80).withColumn("key", key).filter("key <> ''").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    of = paged.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    return counted.join(of, "doc_id").filter(F.col("n") >= F.greatest(F.lit(least), F.floor(share * F.col("pages"))))


#: A phrase in capitals, and it with a page number before or after it, in running text.
CAPITALS = r"\p{Lu}[\p{Lu}'’\- ]{2,40}?\p{Lu}"
NUMBER_FIRST = rf"(?:^|[^\p{{L}}\p{{N}}_])(\d{{1,4}}\s+{CAPITALS})(?:\s|$)"
NUMBER_LAST = rf"(?:^|[^\p{{L}}\p{{N}}_])({CAPITALS}\s+\d{{1,4}})(?:[^\p{{L}}\p{{N}}_/.]|$)"


def header_marks(paras: DataFrame, text: str = "line") -> DataFrame:
    """paras with a row for each `mark` (number and phrase as they stand), its `number` and `phrase`."""
    marks = F.concat(F.regexp_extract_all(text, F.lit(NUMBER_FIRST), 1), F.regexp_extract_all(text, F.lit(NUMBER_LAST), 1))
    found = paras.withColumn("mark", F.explode(marks))
    return found.withColumn("number", F.regexp_extract("mark", r"(\d+)", 1)).withColumn("phrase", F.regexp_replace("mark", r"^\d+\s+|\s+\d+$", ""))


def running_headers(marks: DataFrame, para: str = "line_no") -> DataFrame:
    """doc_id, phrase, numbers, paras: of header_marks, the phrases that are a document's running titles: with 3 numbers and in 3 paragraphs at
    least, and with no number over twice (a bibliography's "IBLA 21" comes again and again)."""
    per = marks.groupBy("doc_id", "phrase", "number").agg(F.count("*").alias("n")).groupBy("doc_id", "phrase").agg(F.count("*").alias("numbers"), F.max("n").alias("most"))
    held = marks.select("doc_id", "phrase", para).distinct().groupBy("doc_id", "phrase").agg(F.count("*").alias("paras"))
    return per.join(held, ["doc_id", "phrase"]).filter("numbers >= 3 AND paras >= 3 AND most <= 2").select("doc_id", "phrase", "numbers", "paras")


def drop_running_headers(paras: DataFrame, para: str = "line_no", text: str = "line") -> DataFrame:
    """paras whose text has lost the running titles of its document, with their numbers. (A word that a title has split is put together by merge_split_words.)"""
    marks = header_marks(paras.select("doc_id", para, text), text)
    mine = marks.join(running_headers(marks, para), ["doc_id", "phrase"], "left_semi").groupBy("doc_id", para).agg(F.array_sort(F.collect_set("mark")).alias("_marks"))
    gone = F.aggregate("_marks", F.col(text), lambda a, m: F.replace(a, m, F.lit("")))
    cut = F.when(F.col("_marks").isNull(), F.col(text)).otherwise(F.trim(F.regexp_replace(gone, " +", " ")))
    return paras.join(mine, ["doc_id", para], "left").withColumn(text, cut).drop("_marks")


def monotone(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows whose value is over every value kept before it: equal to being over every value before it."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_most", F.max(value).over(w)).filter(F.col("_most").isNull() | (F.col(value) > F.col("_most"))).drop("_most")


def junk_parts(c: Column) -> dict[str, Column]:
    """Symbols and letters of a short text, for junk scores."""
    return {"chars": F.length(c).cast("long"), "letters": letters(c), "symbols": count_of(c, r"[^\p{L}\p{N}\s.,;:!?'\"()-]")}


def edit_state(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of each key: the last edit's; and the value once the last edit is undone."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq"))
    ranked = edits.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("current"), F.max(F.when(F.col("r") == 2, F.col("value"))).alias("undone"))


def modal_offset(labels: DataFrame, keys: list[str], at: str, label: str, votes: int = 2) -> DataFrame:
    """keys, modal, n: the commonest difference between a label and its place in order, with so many votes; ties to the least."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    counts = labels.withColumn("modal", F.col(label) - place).groupBy(*keys, "modal").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("modal")).alias("k"))).alias("b"))
    return best.select(*keys, (-F.col("b.k")).alias("modal"), F.col("b.n").alias("n")).filter(F.col("n") >= votes)


def series_gate(numbers: DataFrame, keys: list[str], value: str, low: int, high: int, least: int = 8, share: float = 0.7) -> DataFrame:
    """keys, n, share, series: whether a column of numbers is a series: `least` of them, of whose steps a share lies between low and high."""
    step = F.lead(value).over(Window.partitionBy(*keys).orderBy(value)) - F.col(value)
    good = F.when(F.col("_step").between(low, high), 1.0).when(F.col("_step").isNotNull(), 0.0)
    g = numbers.withColumn("_step", step).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(good).alias("share"))
    return g.withColumn("series", (F.col("n") >= least) & (F.col("share") >= share))


def page_number(lines_: DataFrame, keys: list[str], order: list[str], value: str, sure: Column) -> DataFrame:
    """keys, sure, no: a page's number, from its first or last line; the surer reading, then the earlier line, decides."""
    up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*map(F.desc, order))
    edge = lines_.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).filter("_up = 1 OR _down = 1")
    edge = edge.withColumn("_sure", sure).filter("_sure IS NOT NULL")
    return edge.groupBy(*keys).agg(F.max("_sure").alias("sure"), F.max_by(value, F.struct("_sure", -F.col(order[0]), value)).alias("no"))


def free_positions(covered: DataFrame, keys: list[str], position: str, low: int, high: int) -> DataFrame:
    """keys, free, first_free: places from low to high that nothing covers (the gutter of a page of two columns), for each key with a row."""
    places = covered.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))).alias(position))
    free = places.join(covered.filter(F.col(position).isNotNull()).select(*keys, position).distinct(), [*keys, position], "left_anti")
    return free.groupBy(*keys).agg(F.count("*").alias("free"), F.min(position).alias("first_free"))


def split_notes(paged: DataFrame) -> DataFrame:
    """Lines of pages with `is_note`: from a page's first numbered line on."""
    numbered = F.when(F.col("line").rlike(r"^\d{1,3}[.)]? \p{L}"), F.col("line_no"))
    first = F.min(numbered).over(Window.partitionBy("doc_id", "page_no"))
    return paged.withColumn("is_note", F.coalesce(F.col("line_no") >= first, F.lit(False)))
