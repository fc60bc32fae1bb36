"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import BLANKS, let, word_array

# Function words of English, German, French and Spanish that count as stop words.
STOP_WORDS = (
    "the of and to in is that with for was be on are as by at this it from an or "
    "der die das und ist den dem von mit zu auf für im ein eine nicht sich des "
    "le la les de des et est un une que qui dans en du pour pas au "
    "el los las del y que se con por una para es al lo su"
).split()
STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS))

#: Words of a window, a power of two.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """The document fails if 100 * part is above (or below) percent * whole."""

    name: str
    part: str
    whole: str
    percent: int
    above: bool = True
    least_words: int = 0


#: Production thresholds. Integers only, so that every engine decides alike.
RULES = (
    Rule("words_too_long", "word_chars", "n_words", 1500),
    Rule("words_too_short", "word_chars", "n_words", 200, above=False),
    Rule("symbols", "n_symbols", "n_words", 20),
    Rule("few_stop_words", "n_stop_words", "n_words", 1, above=False, least_words=40),
    Rule("repeated_lines", "n_dup_lines", "n_text_lines", 50),
    Rule("bullet_lines", "n_bullet_lines", "n_text_lines", 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_text_lines", 30),
)


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the text holds at least twice."""

    def joined(hashes: Column, width: int) -> Column:
        """Hashes of windows twice as wide, from those of windows of `width` words."""
        n = F.size(hashes) - width
        return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, width + 1, n), lambda a, b: F.xxhash64(a, b))

    single = F.transform(words, lambda w: F.xxhash64(w))
    doubled = let(single, lambda h1: let(joined(h1, 1), lambda h2: let(joined(h2, 2), lambda h4: joined(h4, 4))))
    hashes = F.when(F.size(words) >= WINDOW, doubled)

    def covered(ordered: Column) -> Column:
        same = lambda s, k: F.get(ordered, k)["h"].eqNullSafe(s["h"])
        repeated = F.filter(ordered, lambda s, k: same(s, k - 1) | same(s, k + 1))
        positions = F.sort_array(F.transform(repeated, lambda s: s["i"]))
        return F.aggregate(
            positions,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )

    def count(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(by_hash, covered)).otherwise(F.lit(0).cast("long"))

    return F.coalesce(let(hashes, count), F.lit(0).cast("long"))


def text_metrics(text: Column) -> Column:
    """One struct with every count that rules may name."""
    body = F.coalesce(text, F.lit(""))

    def measure(v: Column) -> Column:
        words, lines = v["words"], v["lines"]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            _count(words, lambda w: w.isin(*STOP_WORDS)).alias("n_stop_words"),
            F.size(lines).cast("long").alias("n_text_lines"),
            _count(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
            _count(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")).alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(F.struct(word_array(text).alias("words"), lines.alias("lines")), measure)


def failed(rule: Rule) -> Column:
    part, whole = 100 * F.col(rule.part), rule.percent * F.col(rule.whole)
    test = part > whole if rule.above else part < whole
    return test & (F.col("n_words") >= rule.least_words)


def quality_rules(docs: DataFrame, rules=RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts and verdict of every document, from one scan and one projection without user functions.

    Null and empty texts count as texts without words: they fail the base rule (fewer than 20 words).
    Ties and repeated rows are rows of their own, a null id is carried through, an empty table
    gives an empty table. Further columns of the input are neither read nor returned, so their names don't clash.
    Windows of eight words are compared by 64-bit hash within one text.
    Result: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
    n_text_lines, n_bullet_lines, n_ellipsis_lines, base_failed, failed_rules (array), kept.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    named = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    # inline, as filters on the verdict pass a plain projection, and would count everything again
    measured = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(text_metrics(F.col(text_col)))))
    return measured.select("*", base.alias("base_failed"), named.alias("failed_rules"), (~base & (F.size(named) == 0)).alias("kept"))
