"""Quality rules: fixed base rules, and the divergence of a document from its language.

Everything is a DataFrame expression. Every document gets two histograms, of character classes and of
the language's common words; a language's reference, one for every value of the column, is the mean histogram of its documents that
pass the base rules, over the whole table. A document whose Jensen-Shannon distance to its reference passes a limit is dropped, unless it is too
short for its histogram to mean anything. Repeated three-word windows are found inside the row: hashes
of the windows are sorted with their places, equal neighbours are repeats, and their places are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.common import stored

# Common words by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with"),
    "fr": ("de", "la", "le", "les", "des", "et", "un", "une", "en", "que", "est", "qui", "pour", "dans"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "sich", "des", "auf", "nicht", "im"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "para"),
}
#: Rows of the references' table that are broadcast at most; beyond it the join is Spark's choice.
BROADCAST_ROWS = 4096
#: Character classes counted by pattern; white space and the rest make two more bins.
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"""[.,;:!?'"()\-]+""", "symbol": r"[#*$%&|<>]+", "wide": r"[^\x00-\x7F]+"}
WORDS = r"array_remove(split(t, '[ \\t-\\r]+'), '')"
# Places of windows that stand twice or more, merged: each covers three words, or up to the next place.
REPEATED = """
CASE WHEN size({w}) < 3 THEN 0L ELSE
transform(array(transform({w}, x -> xxhash64(x))), h ->
  transform(array(transform(arrays_zip(slice(h, 1, size(h) - 2), slice(h, 2, size(h) - 2), slice(h, 3, size(h) - 2)), s -> xxhash64(s))), win ->
    CASE WHEN size(array_distinct(win)) = size(win) THEN 0L ELSE
    transform(array(array_sort(transform(win, (x, i) -> named_struct('x', x, 'i', i)))), s ->
      transform(array(array_sort(transform(filter(s, (v, k) -> v.x = get(s, k - 1).x OR v.x = get(s, k + 1).x), v -> v.i))), at ->
        aggregate(transform(at, (p, k) -> least(3, coalesce(get(at, k + 1), p + 3) - p)), 0L, (a, n) -> a + n))[0])[0] END)[0])[0] END
"""


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base measures and the two histograms (shares, each with a bin for the rest) per row."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), lang.alias("language"))
    rows = rows.withColumn("w", F.expr(WORDS)).withColumn("j", _common_words())
    counted = rows.select(
        "id", "language", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        *((F.length("t") - F.length(F.regexp_replace("t", p, ""))).cast("long").alias(f"c_{k}") for k, p in CLASSES.items()),
        F.length("t").alias("chars"),
        F.expr(r"transform(array(filter(split(t, '\n', -1), x -> x RLIKE '[^ \\t-\\r]')), x -> size(x) - size(array_distinct(x)))[0]")
        .cast("long").alias("n_dup_lines"),
        F.expr(REPEATED.format(w="w")).alias("n_repeat_words"), _common_counts().alias("common"))
    n = F.greatest(F.col("chars"), F.lit(1))
    shares = [F.col(f"c_{k}") / n for k in CLASSES] + [(F.col("chars") - F.col("word_chars")) / n]
    words = F.transform("common", lambda c: c / F.greatest(F.col("n_words"), F.lit(1)))
    return counted.select(
        "id", "language", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        _with_rest(F.array(*shares)).alias("class_shares"), _with_rest(words).alias("word_shares"))


def _common_words() -> Column:
    """The row's common words, each between two spaces of its own."""
    listed = ", ".join(f"'{w}'" for w in sorted({w for ws in COMMON.values() for w in ws}))
    return F.expr(f"concat(' ', array_join(filter(transform(w, x -> lower(x)), x -> x IN ({listed})), '  '), ' ')")


def _common_counts() -> Column:
    """Occurrences of each common word of the row's language (of English where it is unknown)."""
    def counts(words):
        return F.array(*((F.length("j") - F.length(F.expr(f"replace(j, ' {w} ', '')"))) / (len(w) + 2) for w in words))

    chosen = None
    for lang, words in COMMON.items():
        hit = F.col("language") == lang
        chosen = F.when(hit, counts(words)) if chosen is None else chosen.when(hit, counts(words))
    return chosen.otherwise(counts(COMMON["en"]))


def _with_rest(shares: Column) -> Column:
    return F.transform(F.array(shares), lambda s: F.concat(s, F.array(F.greatest(
        F.lit(0.0), F.lit(1.0) - F.aggregate(s, F.lit(0.0), lambda a, x: a + x))))).getItem(0)


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of the same bins."""
    half = f"""aggregate(zip_with({{x}}, {{y}}, (a, b) -> CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END),
                          0D, (s, v) -> s + v)"""
    return F.expr(f"sqrt(greatest(0D, ({half.format(x=p, y=q)} + {half.format(x=q, y=p)}) / 2))")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                  least_words: int = 50, class_limit: float = 0.3, word_limit: float = 0.55,
                  class_words: int = 50, word_words: int = 100) -> DataFrame:
    """Base measures, ``base_failed``, the two distances and ``kept`` per row.

    ``base_failed``: fewer than ``least_words`` words, or more than half of the words in three-word
    windows that the text holds twice or more. ``kept``: not ``base_failed``, and the character-class and
    common-word histograms lie within ``class_limit`` and ``word_limit`` of the language's mean, each judged
    only from ``class_words`` and ``word_words`` words on.

    NULL text counts as empty. Every language value has its own references; NULL and '' share one. Words are judged only in languages
    with a word list. Repeated rows and NULL ids pass through; each row counts towards its reference. Empty in, empty out.
    """
    rows = stored(statistics(docs, id_col, text_col, lang_col), "statistics")
    sizes = {"class_shares": len(CLASSES) + 2, "word_shares": len(COMMON["en"]) + 1}
    n = F.col("n_words")
    failed = (n < least_words) | (100 * F.col("n_repeat_words") > 50 * n)
    means = stored(rows.where(~failed).groupBy("language")
                   .agg(*(F.array(*(F.avg(F.col(c)[i]) for i in range(n_bins))).alias(f"mean_{c}") for c, n_bins in sizes.items())), "references")
    few = means.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(means) if few else means, "language", "left")
    distances = {f"{kind}_distance": F.coalesce(_distance(f"{kind}_shares", f"mean_{kind}_shares"), F.lit(0.0)) for kind in ("class", "word")}
    far = (((n >= class_words) & (F.col("class_distance") > class_limit))
           | (F.col("language").isin(*COMMON) & (n >= word_words) & (F.col("word_distance") > word_limit)))
    return (joined.withColumns(distances).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "class_distance", "word_distance"))
