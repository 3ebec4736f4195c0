"""Line-first quality rules, all in DataFrame functions.

Lines are judged one by one for punctuation, navigation and boilerplate; failing lines are removed, and
a document that loses too much of its text that way is rejected, as is one that breaks a rule on whole
texts (too few words, too much repetition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, words

MIN_WORDS = 50
#: Largest percentage of words in repeated three-word windows.
MAX_REPEATED = 50
#: Largest percentage of a text's word characters that failing lines may hold.
MAX_LOST = 50
#: A line is noise if more than this percentage of its words carries a symbol or shouts.
MAX_NOISE = 30
#: A line is navigation if it has this many separators and they are this percentage of its words.
SEPARATORS, SEPARATOR_SHARE = 3, 20
SYMBOLS = "#*$%&|<>"
#: Separators between menu entries, standing alone as a word.
SEPARATOR_WORD = r"^(\||»|›|•|·|>|/|::)$"
#: Short lines that hold nothing but one of these are navigation.
MENU = ("home", "menu", "log in", "login", "sign in", "sign up", "register", "next", "previous", "back to top",
        "read more", "show more", "share", "tweet", "print", "skip to content", "search", "sitemap", "site map")
#: Phrases of notices that sites put on every page.
BOILERPLATE = ("all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
               "we use cookies", "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
               "subscribe to our newsletter", "click here to")
NOISE = r"[#*$%&<>]{2}|!!|\?\?"
#: What a line must at least hold to be noise or navigation, to be a menu entry (three words at most), or a
#: notice (each phrase has one of these words).
MARKED = r"[#*$%&<>|/»›•·]|[!?:]{2}"
SHORT = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,3}+\z"
NOTICE = ("reserved", "policy", "terms", "cookies", "javascript", "ipsum", "newsletter", "click")


def _share(part: Column, whole: Column, limit: int) -> Column:
    return F.lit(100) * part > F.lit(limit) * whole


def bad_line(line: Column) -> Column:
    """Whether a line fails; lines without a word pass (they hold no text to lose).

    Only lines in which something may fail are cut into words.
    """
    def judged(ws: Column) -> Column:
        n = F.size(ws)
        noisy = F.size(F.filter(ws, lambda w: w.rlike(NOISE)))
        bars = F.size(F.filter(ws, lambda w: w.rlike(SEPARATOR_WORD)))
        plain = F.lower(F.array_join(ws, " "))
        entry = F.regexp_replace(plain, r"[^\p{L} ]", "")
        return (n > 0) & (_share(noisy, n, MAX_NOISE)
                          | ((bars >= SEPARATORS) & _share(bars, n, SEPARATOR_SHARE))
                          | ((n <= 3) & entry.isin(*MENU))
                          | plain.rlike("|".join(BOILERPLATE)))

    def suspect(low: Column) -> Column:
        some = low.rlike(MARKED) | low.rlike(SHORT)
        for word in NOTICE:
            some = some | F.contains(low, F.lit(word))
        return some

    return F.when(let(F.lower(line), suspect), let(words(line), judged)).otherwise(False)


def repeat_words(ws: Column) -> Column:
    """Words that lie in a three-word window found twice or more among `ws`."""
    def windows(w: Column) -> Column:
        # windows by content, then place; a repeated one stands beside its like
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        # each window covers three words, or as many as come before the next repeated one starts
        return F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))),
                           F.lit(0), lambda total, x: total + x)

    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(let(let(windows(ws), repeated), covered)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_base_failed,
    q_lost_chars, q_kept and q_text (the text without failing lines; null stays null).

    Null and empty texts have no words and fail.  A repeated row is judged like its first, ties cannot
    occur, an empty table stays empty, and columns of `docs` with these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    with_word = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda s: F.length(F.translate(s, BLANKS, ""))
    kept_lines = F.filter(lines, lambda x: ~bad_line(x))
    out = docs.withColumns({
        "q_words": F.size(words(F.col(text))).cast("long"), "q_word_chars": chars(t).cast("long"),
        "q_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "q_dup_lines": let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("long"),
        "q_repeat_words": let(words(F.col(text)), repeat_words),
        "q_text": F.when(F.col(text).isNotNull(), F.array_join(kept_lines, "\n"))})
    out = out.withColumns({
        "q_base_failed": (F.col("q_words") < MIN_WORDS) | _share(F.col("q_repeat_words"), F.col("q_words"), MAX_REPEATED),
        "q_lost_chars": F.when(F.col("q_text") == F.col(text), F.lit(0).cast("long")).otherwise(
            F.col("q_word_chars") - F.coalesce(chars(F.col("q_text")), F.lit(0)))})
    return out.withColumn("q_kept", ~F.col("q_base_failed") & ~_share(F.col("q_lost_chars"), F.col("q_word_chars"), MAX_LOST))
