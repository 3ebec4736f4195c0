"""Text helpers as jobs over text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# Fixed value: the id grammar.
ID_PATTERN = (r"\b(?:POS|PO|MC|MCH|IPV|MAP|PNL|CTL|APR|ESC|EV|RC|CA|INC|GAP|OVR)-[A-Za-z0-9:._-]*[A-Za-z0-9]")
#: Characters a mention must not touch.
BOUND = "A-Za-z0-9_&"


def mention_ids(texts: DataFrame, pattern: str = ID_PATTERN) -> DataFrame:
    """Entity ids named in `texts(text_id, text)`, distinct, in order of first mention."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))
    return texts.select("text_id", F.posexplode(ids).alias("pos", "id"))


#: What windows are made of: a run of those, or any one character beyond ASCII; and what stands between.
RUN, GAP = rf"(?:[{BOUND}]+|[^\x00-\x7F])", rf"[\x00-\x7F&&[^{BOUND}]]*"


def _runs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), 0), lambda x: F.lower(x))


def _key_length(n: Column) -> Column:
    """Runs of a spelling that its key covers: all up to four, else the largest power of two among them."""
    return F.when(n <= 4, n).otherwise(F.call_function("shiftleft", F.lit(1), F.floor(F.log2(n)).cast("int")))


def _with_hashes(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Columns `h1`, `h2`, ...: hashes of all windows of as many `runs`, each made from two of shorter windows."""
    halves = {n: (n - n // 2, n // 2) for n in (2, 3, *[1 << k for k in range(2, max(lengths).bit_length())])}
    rows = rows.withColumn("h1", F.transform("runs", lambda x: F.xxhash64(x)))
    for n in sorted(halves):
        left, right = halves[n]
        at = F.when(F.size("runs") >= n, F.sequence(F.lit(0), F.size("runs") - n)).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn(f"h{n}", F.transform(at, lambda i: F.xxhash64(F.get(f"h{left}", i), F.get(f"h{right}", i + left))))
    return rows


def _term_windows(terms: DataFrame) -> DataFrame:
    """(runs, n, term, alt, spelling, lead): every spelling of every entry, its word runs and how many of them its key covers.

    `terms` has `term` and, where there are any, `aliases` (an array).  Spellings of nothing but ASCII punctuation are left out.
    """
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in terms.columns else F.array().cast("array<string>")
    spelled = terms.where("term is not null").select("term", F.posexplode(F.concat(F.array("term"), aliases)).alias("alt", "spelling"))
    once = spelled.groupBy("term", "spelling").agg(F.min("alt").alias("alt"))
    runs = once.withColumn("runs", _runs(F.col("spelling"))).where(F.size("runs") > 0)
    return runs.select("runs", _key_length(F.size("runs")).alias("n"), "term", "alt", "spelling",
                       F.length(F.regexp_extract("spelling", f"^{GAP}", 0)).alias("lead"))


def glossary_tag(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """First mention of every glossary entry per text: text_id, para, term, start, length.

    Paragraph by paragraph the earliest mention of an entry not seen yet is taken, the longest on ties, and
    the search goes on behind it.  Mentions are spellings (the term or an alias) without regard to case that
    do not touch a word character or `&`.  Hashes of word windows meet the first words of the spellings by
    equality, so the glossary's size does not matter; a hit is then compared with the text itself.  Windows
    have up to four words or a power of two, so there are few lengths of them however many the spellings have.
    """
    spelled = _term_windows(terms)
    lengths = sorted(r[0] for r in spelled.select("n").distinct().collect())
    if not lengths:
        return texts.select("text_id", F.lit(0).alias("para"), F.lit("").alias("term"), F.lit(0).alias("start"), F.lit(0).alias("length")).limit(0)
    paras = texts.select("text_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para", "line"))
    runs = _with_hashes(paras.select("text_id", "para", _runs(F.col("line")).alias("runs")), lengths)
    key = F.coalesce(*[F.when(F.col("n") == n, F.get(f"h{n}", F.lit(0))) for n in lengths])
    # filters on hashes would move below the columns they come from and compute these anew for every element
    keys = written(_with_hashes(spelled, lengths).select(key.alias("key"), "n", "term", "alt", "spelling", "lead"), "glossary-keys")
    held = runs.select("text_id", "para", F.inline_outer(F.concat(*[
        F.transform(f"h{n}", lambda h, i: F.struct(h.alias("key"), F.lit(n).alias("n"), i.alias("at"))) for n in lengths])))
    hits = held.join(keys, ["key", "n"]).groupBy("text_id", "para").agg(F.collect_list(F.struct("at", "term", "alt", "spelling", "lead")).alias("hits"))
    # place of a run in its line: what stands before it, separators and runs
    read = paras.select(F.col("text_id").alias("of"), F.col("para").alias("no"), "line")
    lines = hits.join(read, F.col("text_id").eqNullSafe(F.col("of")) & (F.col("para") == F.col("no"))).select(
        "text_id", "para", "line", "hits", F.transform(F.split("line", RUN, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all("line", F.lit(RUN), 0), F.length).alias("sizes"))

    def before(at: Column) -> Column:
        return sum(F.aggregate(F.slice(c, 1, n), F.lit(0), lambda x, y: x + y) for c, n in (("gaps", at + 1), ("sizes", at)))

    starts = F.transform("hits", lambda h: F.struct((before(h["at"]) - h["lead"]).alias("start"), h["term"].alias("term"), h["alt"].alias("alt"),
                                                    h["spelling"].alias("spelling")))
    placed = lines.select("text_id", "para", "line", F.inline_outer(starts))
    size = F.length("spelling")

    def free(at: Column) -> Column:
        return ~F.substring(F.col("line"), at, F.lit(1)).rlike(f"[{BOUND}]")

    exact = placed.where(F.col("start") >= 0).where(
        (F.lower(F.substring(F.col("line"), F.col("start") + 1, size.cast("int"))) == F.lower("spelling"))
        & (F.when(F.col("start") == 0, True).otherwise(free(F.greatest(F.col("start"), F.lit(1))))) & free(F.col("start") + size + 1))
    # at one place an entry counts by its first spelling
    first = exact.groupBy("text_id", "para", "start", "term").agg(F.min(F.struct("alt", size.alias("length"))).alias("m"))
    some = first.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct(
        "para", "start", (-F.col("m.length")).alias("neg"), "term"))).alias("found"))

    def take(done: Column, c: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        behind = (F.size(done) == 0) | (c["para"] > last["para"]) | (c["start"] >= last["start"] - last["neg"])
        return F.when(behind & ~F.exists(done, lambda x: x["term"] == c["term"]), F.concat(done, F.array(c))).otherwise(done)

    kind = "array<struct<para:int,start:int,neg:int,term:string>>"
    taken = F.aggregate(F.col("found").cast(kind), F.array().cast(kind), take)
    return some.select("text_id", F.inline(taken)).select("text_id", "para", "term", "start", (-F.col("neg")).alias("length"))


def _first_of(text: Column, needles: tuple[str, ...]) -> Column:
    """1-based place of the first of the needles, null if there is none."""
    hits = [F.nullif(F.instr(text, n), F.lit(0)) for n in needles]
    return hits[0] if len(hits) == 1 else F.least(*hits)


def _tiered(text: Column, tiers: tuple[tuple[str, ...], ...]) -> Column:
    return F.coalesce(*[_first_of(text, t) for t in tiers])


def chronology_grade(texts: DataFrame, change, override, review, rules: tuple[str, ...], least_rules: int = 2) -> DataFrame:
    """Whether each text tells the change before the review, names the override and enough rules.

    `change`, `override`, `review` are tiers of needles: a later tier counts only if no earlier one occurs.
    """
    t = F.lower("text")
    named = sum((F.when(F.contains(t, F.lit(r)), 1).otherwise(0) for r in rules), F.lit(0))
    rows = texts.select("text_id", _tiered(t, change).alias("c"), _tiered(t, override).alias("o"), _tiered(t, review).alias("r"),
                        named.alias("n"))
    reason = (F.when(F.col("c").isNull(), "no change").when(F.col("o").isNull(), "no override")
              .when(F.col("r").isNull(), "no review").when(F.col("c") >= F.col("r"), "order")
              .when(F.col("n") < least_rules, "rules").otherwise("ok"))
    return rows.select("text_id", (reason == "ok").alias("passed"), reason.alias("reason"))
