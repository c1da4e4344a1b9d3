"""Benchmark decontamination by a distributed positional inverted index.

Every different window of the benchmark names its two rarest terms, by their counts in the training texts. The index holds one
posting (term, document, position) for every training token of such a term; no other token can anchor a match. Postings,
shifted by their offsets in the item, must agree on one alignment of item and document. The windows between the anchors that
agree are then compared with the document's own words. A window that stands several times in the benchmark is looked for
once, so the work stays linear in texts of repeated words. All steps are DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroloom.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())  # with A-Z, which are lowered, all that WORD leaves out
WINDOW = 13
SLACK = 3  # words that may stand between those of a window in a proximity match
MIN_HIT_SHARE = 20  # contaminated from one hit word in so many


def words(text: Column) -> Column:
    """Words of a text (matches of WORD), A-Z in lower case; none of a null text.

    All characters between words become spaces, where a split needs no regular expression.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _GAPS, string.ascii_lowercase + " " * len(_GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """`doc_id, key, text`: rows alike in doc_id and text share their key. Others may by chance, which costs a comparison, no result."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def item_table(items: DataFrame) -> DataFrame:
    """`item_no, item_id, item, span`: words of each item that has any, and the length of its windows; repeated items once."""
    own = items.select(F.col("item_id"), words(F.col("text")).alias("item")).filter(F.size("item") > 0).distinct()
    return own.select(F.monotonically_increasing_id().alias("item_no"), "item_id", "item", F.least(F.size("item"), F.lit(WINDOW)).alias("span"))


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """`term, df`: training tokens of each of the (distinct) terms."""
    tokens = texts.select(F.explode(words(F.col("text"))).alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def window_table(items: DataFrame, counts: DataFrame) -> DataFrame:
    """`phrase, item_id, item_no, k, span, rarest`: every window, its place in the item, and its two rarest terms with theirs.

    A term that no text has counts 0, so windows that hold it are anchored there and match nothing.
    """
    placed = items.select("item_no", "item_id", "span", F.size("item").alias("n"), F.posexplode("item").alias("at", "term"))
    ranked = placed.join(counts, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per_item = ranked.groupBy("item_no", "item_id", "span", "n").agg(F.array_sort(F.collect_list(F.struct("at", "df", "term"))).alias("own"))
    starts = F.sequence(F.lit(0), F.col("n") - F.col("span"))
    windows = per_item.select(
        "item_no", "item_id", "span",
        F.explode(F.transform(starts, lambda k: F.struct(k.alias("k"), F.slice("own", k + 1, F.col("span")).alias("own")))).alias("w"),
    )
    rarest = F.slice(F.array_sort(F.transform("w.own", lambda p: F.struct(p["df"], p["at"], p["term"]))), 1, 2)
    phrase = F.array_join(F.transform("w.own", lambda p: p["term"]), " ")
    return windows.select(phrase.alias("phrase"), "item_id", "item_no", F.col("w.k").alias("k"), "span", rarest.alias("rarest"))


def build_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """`term, key, pos` of the training tokens whose term is in `terms` (distinct)."""
    postings = texts.select("key", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return postings.join(terms, "term", "left_semi").select("term", "key", "pos")


def candidates(index: DataFrame, windows: DataFrame, slack: int = 0) -> DataFrame:
    """`key, start, span, phrase`: places where the anchors of a window stand at their offsets, or up to `slack` words behind.

    Of equal windows one stands for all. Postings are gathered by the alignment of item and document; with slack by
    steps of alignments, each with the next, as both anchors then lie in one of these.
    """
    first = windows.groupBy("phrase").agg(F.min(F.struct("item_no", "k", "span", "rarest")).alias("r")).select("phrase", "r.*")
    anchors = first.select("item_no", F.least("span", F.lit(2)).alias("need"), F.explode("rarest").alias("p"))
    anchors = anchors.groupBy("item_no", F.col("p.term").alias("term"), F.col("p.at").alias("at")).agg(F.min("need").alias("need"))
    step = F.floor((F.col("pos") - F.col("at")) / (slack + 1)).cast("int")
    met = index.join(anchors, "term").select("key", "item_no", "at", "need", F.explode(F.array(step - 1, step) if slack else F.array(step)).alias("step"))
    agreed = (
        met.groupBy("key", "item_no", "step")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("need").alias("need"))
        .filter((F.col("need") < 2) | (F.col("low") < F.col("high")))
    )
    bounds = F.transform("rarest", lambda p: p["at"])
    own = first.select("item_no", "k", "span", "phrase", F.array_min(bounds).alias("from"), F.array_max(bounds).alias("to"))
    inside = agreed.join(own, "item_no").filter((F.col("from") >= F.col("low")) & (F.col("to") <= F.col("high")))
    shift = F.col("step") * (slack + 1) + F.col("k")
    starts = F.sequence(shift, shift + slack)
    return inside.select("key", F.explode(starts).alias("start"), "span", "phrase").filter("start >= 0").distinct()


def _looked_up(docs: DataFrame, benchmark: DataFrame, slack: int) -> tuple[DataFrame, DataFrame]:
    """(`doc_id, key, own, found` of every document, `found` being its candidates; all windows of the benchmark)."""
    texts = keyed_texts(docs)
    items = cut_lineage(item_table(benchmark), "items")
    terms = items.select(F.explode("item").alias("term")).distinct()
    windows = cut_lineage(window_table(items, term_counts(texts, terms)), "benchmark-windows")
    rare = windows.select(F.explode("rarest.term").alias("term")).distinct()
    index = cut_lineage(build_index(texts, rare), "positional-index")
    found = candidates(index, windows, slack).groupBy("key").agg(F.collect_list(F.struct("start", "span", "phrase")).alias("found"))
    # The words are made once, below the join, and kept by it.
    return texts.join(found, "key", "left").select("doc_id", "key", words(F.col("text")).alias("own"), "found"), windows


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated` of every document.

    A null text has no words; an item without words matches nothing; repeated items count once, by id and words, and an id
    with several texts is hit by any of them. Rows that share a doc_id, or have none, are told apart by their texts; repeated
    rows have equal results. The benchmark side is left to Spark's own size checks: small it is broadcast, else both sides
    are shuffled by term, where adaptive execution splits the lists of hot terms.
    """
    joined, windows = _looked_up(docs, benchmark, 0)
    same = F.filter("found", lambda f: F.array_join(F.slice("own", f["start"] + 1, f["span"]), " ") == f["phrase"])
    hits = joined.select("doc_id", "key", F.size("own").cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), same).alias("hits"))
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["span"] - 1))))
    counted = cut_lineage(
        hits.select(
            "doc_id", "key", "n_words", F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda h: h["phrase"])).alias("phrases"),
        ).withColumn("n_hit", F.greatest("n_hit", F.lit(0).cast("long"))),
        "hits",
    )
    # Equal phrases are equal windows, so a document's key and phrases stand for its result.
    digest = F.sha2(F.array_join("phrases", "\n"), 256)
    named = counted.filter("n_hit > 0").select(F.col("key").alias("own_key"), digest.alias("own_digest"), "phrases").distinct()
    ids = (
        named.select("own_key", "own_digest", F.explode("phrases").alias("phrase"))
        .join(windows.select("phrase", F.col("item_id").cast("string").alias("id")).distinct(), "phrase")
        .groupBy("own_key", "own_digest").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    )
    hit = counted.filter("n_hit > 0").withColumn("digest", digest)
    full = hit.join(ids, (F.col("key") == F.col("own_key")) & (F.col("digest") == F.col("own_digest"))).select("doc_id", "n_words", "n_hit", "ids")
    none = counted.filter("n_hit = 0").select("doc_id", "n_words", "n_hit", F.array().cast("array<string>").alias("ids"))
    # Written, so that a caller's filter on the result is not pushed below the steps above, where it would repeat them.
    return cut_lineage(
        full.unionByName(none).select(
            "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
            F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * MIN_HIT_SHARE >= F.col("n_words"))).alias("contaminated"),
        ),
        "contamination",
    )


def proximity(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, item_id, start, end`: stretches of a document that hold a whole window of an item in order, looser than a hit.

    A stretch begins with the window's first word, ends where its last word is first reached, and has at most `SLACK` other
    words between them; without any it is an exact hit.
    """
    joined, windows = _looked_up(docs, benchmark, SLACK)

    def reached(place: Column) -> Column:
        """End of the stretch from a place, or -1: each word is looked for behind the one before it."""
        stretch = F.slice("own", place["start"] + 1, place["span"] + SLACK)

        def walk(at: Column, word: Column) -> Column:
            ahead = F.array_position(F.slice(stretch, F.greatest(at, F.lit(0)) + 1, place["span"] + SLACK), word).cast("int")
            lost = (at < 0) | (ahead == 0) | ((at == 0) & (ahead != 1))
            return F.when(lost, F.lit(-1)).otherwise(at + ahead)

        return F.aggregate(F.split(place["phrase"], " "), F.lit(0), walk)

    ends = F.transform("found", lambda f: F.struct(f["start"].alias("start"), (f["start"] + reached(f)).alias("end"), f["phrase"].alias("phrase")))
    kept = joined.filter(F.col("found").isNotNull()).select("doc_id", F.explode(F.filter(ends, lambda e: e["end"] > e["start"])).alias("e"))
    return kept.select("doc_id", "e.*").distinct().join(windows.select("phrase", "item_id").distinct(), "phrase").select("doc_id", "item_id", "start", "end").distinct()
