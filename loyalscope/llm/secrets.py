"""Secret scans: fixed patterns, and character Markov models of random strings and of identifiers.

Everything is a DataFrame expression (no Python on the executors). Spark has no function that gives the
places of a pattern's matches, so a text is both split at and extracted by the pattern: a match starts
after the pieces and matches before it.

The method's own spans are runs of token characters, or what base spans leave of them, that a first-order
Markov chain of random strings explains better than one of ordinary identifiers: the mean and the sum
of log P(b|a, random) - log P(b|a, identifier) over neighbouring characters pass two thresholds. Both
chains are counted from labelled samples with add-one smoothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyalscope.llm.samples import hashed_sample

# The base kinds in their order, their patterns, the group that is measured and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),     # runs are maximal: a shorter one hides no longer one
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KIND = "random"
#: Runs of token characters that the models judge.
LEAST = 16
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
#: Matches whose lengths are summed one by one.
CHUNK = 256
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
MARK = "[SECRET]"


def _matches(text: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, value) of a pattern's matches whose ``group`` has ``least`` characters.

    Places are sums of the lengths before: by ``CHUNK`` matches, then inside the chunk, so the work per match is bounded.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found, cut = f"regexp_extract_all({text}, '{quoted}', 0)", f"split({text}, '{quoted}', -1)"
    add = "0, (a, x) -> a + x"
    return F.expr(f"""
        CASE WHEN size({found}) > 0 THEN
          filter(transform(array(named_struct('m', {found}, 'p', {cut})), z ->
            transform(array(transform(z.m, (v, i) -> length(z.p[i]) + length(v))), l ->
              transform(array(transform(sequence(0, (size(l) - 1) div {CHUNK}), c -> aggregate(slice(l, CAST(c * {CHUNK} + 1 AS INT), {CHUNK}), {add}))), s ->
                transform(array(transform(s, (v, c) -> aggregate(slice(s, 1, c), {add}))), f ->
                  transform(z.m, (v, k) -> transform(array(
                    f[CAST(k div {CHUNK} AS INT)] + aggregate(slice(l, CAST((k div {CHUNK}) * {CHUNK} + 1 AS INT), k % {CHUNK}), {add}) + length(z.p[k])), at ->
                      named_struct('start', at, 'end', at + length(v), 'value', v))[0])
            )[0])[0])[0])[0],
            s -> length(regexp_extract(s.value, '{quoted}', {group})) >= {least})
        ELSE CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, value: STRING>>) END""")


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios by character pair from ``text`` and ``label`` (1 random, 0 identifier).

    The result has one number per pair of ``ALPHABET``, whatever the number of samples. Other
    characters, NULL texts and labels are passed over; without samples all ratios are 0.
    """
    n = len(ALPHABET)
    pairs = samples.where(F.col("label").isin(0, 1) & (F.length("text") > 1)).select(
        "label", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair"))
    counts = {(r.label, r.pair): r["count"] for r in
              pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").count().collect()}
    ratios = []
    total = {(k, a): sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (0, 1) for a in ALPHABET}
    for a in ALPHABET:
        for b in ALPHABET:
            p, q = (math.log((counts.get((k, a + b), 0) + 1) / (total[k, a] + n)) for k in (1, 0))
            ratios.append(p - q)
    return ratios


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 500) -> DataFrame:
    """Samples to fit on: the words of at most ``rows`` documents, alone and joined as in code
    (identifiers), and digests in hex, base 64, upper case and without symbols (random strings)."""
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    words = (hashed_sample(texts, rows, "i", "t")
             .select(F.expr("regexp_extract_all(t, '[A-Za-z]{2,}', 0)").alias("w")))
    identifiers = words.select(F.explode(F.expr("""
        flatten(transform(w, (x, k) -> array(x, lower(x),
            concat(lower(x), '_', lower(get(w, k + 1))), concat(lower(x), initcap(get(w, k + 1))),
            concat(lower(x), '-', lower(get(w, k + 1))), concat(lower(x), '/', lower(get(w, k + 1)), '_', k % 100))))""")).alias("text"))
    base64 = F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))
    plain = F.regexp_replace(base64, "[+/=]", "")
    random = docs.sparkSession.range(rows * 16).select(F.explode(F.array(
        F.sha2(F.col("id").cast("string"), 256), base64, plain, F.upper(plain), F.translate(base64, "+/", "-_"))).alias("text"))
    return identifiers.withColumn("label", F.lit(0)).unionByName(random.withColumn("label", F.lit(1)))


def find_secrets(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text",
                 mean: float = 1.2, total: float = 12.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``text_col``, the ``keep`` columns and ``spans`` per row.

    ``spans``: array of ``start, rank, end, kind`` (code points, end exclusive) by start, then kind in the order
    assign, access, hex, random. Base matches are leftmost and not overlapping per kind; kinds may
    overlap. NULL or empty text: no spans. Repeated rows and NULL ids pass through.
    """
    n = len(ALPHABET)
    own = docs.select(id_col, text_col, *keep)
    text = "coalesce(`_t`, '')"
    found = own.withColumn("_t", F.col(text_col))
    kinds = [k for k, *_ in BASE]
    for kind, pattern, group, least in BASE:
        found = found.withColumn(f"_{kind}", _matches(text, pattern, group, least))
    found = found.withColumn("_runs", _matches(text, RUN))
    base = f"concat({', '.join(f'_{k}' for k in kinds)})"
    table = F.array(*(F.lit(float(x)) for x in ratios))
    found = found.withColumn("_llr", table)
    # What base spans leave of a run is judged: a part begins at the run's start or after a base span and ends at the next one or the run's end.
    parts = found.withColumn("_base", F.expr(base)).withColumn("_parts", F.expr(f"""
        flatten(transform(_runs, r -> transform(array(filter(_base, b -> b.start < r.end AND r.start < b.end)), over ->
          CASE WHEN size(over) = 0 THEN array(r) ELSE
            filter(transform(filter(array_distinct(concat(array(r.start), transform(over, b -> b.end))),
                                    x -> x < r.end AND NOT exists(over, b -> b.start <= x AND x < b.end)),
                             x -> transform(array(array_min(concat(array(r.end), transform(filter(over, b -> b.start >= x), b -> b.start)))), y ->
                               named_struct('start', x, 'end', y, 'value', substring(r.value, x - r.start + 1, y - x)))[0]),
                   q -> q.end - q.start >= {LEAST}) END)[0]))"""))
    judged = parts.withColumn("_random", F.expr(f"""
        filter(_parts, r -> aggregate(transform(array(transform(split(r.value, ''), c -> instr('{ALPHABET}', c) - 1)), k ->
            aggregate(sequence(1, length(r.value) - 1), CAST(0 AS DOUBLE), (a, i) -> a + _llr[k[i - 1] * {n} + k[i]]))
          , CAST(0 AS DOUBLE), (a, x) -> a + x, a -> a >= {total} AND a >= {mean} * (length(r.value) - 1)))"""))
    arrays = ", ".join(f"transform(_{k}, s -> named_struct('start', s.start, 'rank', {i}, 'end', s.end, 'kind', '{k}'))"
                       for i, k in enumerate([*kinds, KIND]))
    return judged.select(id_col, text_col, *keep, F.expr(f"array_sort(concat({arrays}))").alias("spans"))


def redact(docs: DataFrame, ratios: list[float], id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows with every span of ``find_secrets`` replaced by ``MARK`` (overlapping spans by one); NULL stays NULL."""
    found = find_secrets(docs, ratios, id_col, text_col, keep=keep)
    clean = F.expr(f"""CASE WHEN size(spans) = 0 THEN `{text_col}` ELSE
        aggregate(spans, named_struct('out', '', 'at', 0), (a, s) -> named_struct(
            'out', CASE WHEN s.start < a.at THEN a.out ELSE concat(a.out, substring(`{text_col}`, a.at + 1, s.start - a.at), '{MARK}') END,
            'at', greatest(a.at, s.end)),
          a -> concat(a.out, substring(`{text_col}`, a.at + 1))) END""")
    return found.withColumn(text_col, clean).drop("spans")
