"""Operator 2, quality rules with adaptive thresholds, in DataFrame functions only.

Measures of a text (words, their characters, symbols, repeated lines, words in repeated windows of
three) become ratios, and mergeable KLL quantile sketches of each ratio, and of the numbers of words and
lines, are built per language and source. No threshold is a fixed cutoff: a group's upper fence stands
``SPREAD`` quartile distances above its upper quartile. Where a group's quartiles coincide, as they do for
ratios that are zero in most texts, the reach is what a few events amount to in the group's median text:
``SPREAD`` symbols over its median number of words, ``SPREAD`` lines over its median number of lines, one
line said twice; for the mean word length, which is a measure of the middle, a lower fence stands below the
lower quartile too, and its quartile distance counts as ``LEAST_RELATIVE`` of the median at least. Groups
with fewer than ``MIN_GROUP`` texts use the sketch merged over their language, or else over everything.
Texts join the fences of their language and source, and one outside any fence isn't kept. Texts that fail
the base rules are never kept and don't count in the sketches.

Each task reduces its rows to one sketch per group before anything is exchanged, so a source with a
third of all rows costs no more than another. The fences are broadcast while there are at most
``MAX_BROADCAST_GROUPS`` of them, and joined by the planner's choice beyond.

Null and empty texts have no words, hence fail the base rules. Null languages and sources are groups
of their own. Very long texts are measured whole, as arrays of words and windows inside one row. An empty
table gives no rows. Repeated rows are judged each. Extra columns pass through under any name; one named
like an output is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldpulse.llm.shared import materialize, named, others, pack, unpack

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP, SPREAD, SKETCH_K = 50, 3.0, 1024
MAX_BROADCAST_GROUPS = 50_000
#: The share of its median that a two-sided ratio's quartile distance counts as at least.
LEAST_RELATIVE = 0.1
#: (ratio, the measure that says how much one event weighs in it, events of the least reach; none for the two-sided ratio).
RULES = (
    ("symbols_per_word", "n_words", SPREAD),
    ("dup_line_share", "n_lines", SPREAD),
    ("repeat_word_share", "n_lines", 2.0),
    ("mean_word_chars", None, None),
)
SKETCHED = ("symbols_per_word", "dup_line_share", "repeat_word_share", "mean_word_chars", "n_words", "n_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_POSITION = 2**31 - 1
NEAR = 8


def _window_keys(words: Column) -> Column:
    """The windows of three words as sorted longs, 33 bits of hash and 31 of position, so copies are neighbours."""
    key = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))
    return F.sort_array(F.slice(key, 1, F.greatest(F.size(words) - 2, F.lit(0))))


def _repeated_positions(words: Column, keys: Column) -> Column:
    """Sorted positions of the windows that occur twice or more.

    Words decide whether neighbours are equal; where a hash is shared by different windows, all
    others of the text are asked too, so no collision changes the result.
    """

    def position(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_POSITION)).cast("int")

    def equal(x: Column, y: Column) -> Column:
        a, b = position(x), position(y)
        return F.coalesce((F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2)), F.lit(False))

    def repeated(x: Column, k: Column) -> Column:
        def hash_of(y: Column) -> Column:
            return F.coalesce(F.shiftright(y, 31) == F.shiftright(x, 31), F.lit(False))

        before, after = F.get(keys, k - 1), F.get(keys, k + 1)
        near = (hash_of(before) & equal(x, before)) | (hash_of(after) & equal(x, after))
        # Equal hashes are neighbours, so a few keys around are asked; all of them only where the run is longer.
        longer = (hash_of(F.get(keys, k - NEAR)) & (k >= NEAR)) | hash_of(F.get(keys, k + NEAR))
        around = F.slice(keys, F.greatest(k - NEAR + 2, F.lit(1)), 2 * NEAR - 1)

        def same(y: Column) -> Column:
            return hash_of(y) & (y != x) & equal(x, y)

        return (hash_of(before) | hash_of(after)) & (near | F.when(longer, F.exists(keys, same)).otherwise(F.exists(around, same)))

    return F.array_sort(F.transform(F.filter(keys, repeated), position))


def _covered(positions: Column) -> Column:
    """Words inside windows of three at sorted ``positions``."""
    steps = F.transform(positions, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(positions, k + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x)


def _measured(rows: DataFrame) -> DataFrame:
    """The column ``text`` of ``rows`` as measures (long); the other columns have none of the names used here."""
    keep = [c for c in rows.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.select(*keep, words.alias("words"), lines.alias("lines"), F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"))
    keyed = split.select(
        *keep,
        "n_symbols",
        "words",
        _window_keys(F.col("words")).alias("keys"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    marked = keyed.withColumn("found", _repeated_positions(F.col("words"), F.col("keys")))
    return marked.select(*keep, *[c for c in MEASURES if c != "n_repeat_words"], _covered(F.col("found")).alias("n_repeat_words"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the measures (long)."""
    keep = others(docs, text_col, *MEASURES)
    return _measured(pack(docs, keep, text=named(text_col))).select(*unpack(keep), *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratios(measured: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return measured.withColumns({
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "mean_word_chars": F.col("word_chars") / words,
    })


def _group(measured: DataFrame) -> DataFrame:
    """One row per ``lang`` and ``source`` with the group's sketches: its own, or those of its language or of all texts."""
    sound = ratios(measured.filter(~base_failed()))
    own = sound.groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias(c) for c in SKETCHED])
    # From here on there's one small row per group; sketches merge from sources to languages to all.
    own = materialize(own, "op2-sketches")
    lang = own.groupBy(F.col("lang").alias("of")).agg(*[F.kll_merge_agg_double(c).alias(f"lang_{c}") for c in SKETCHED])
    every = lang.agg(*[F.kll_merge_agg_double(f"lang_{c}").alias(f"all_{c}") for c in SKETCHED])
    levels = own.join(lang, own["lang"].eqNullSafe(lang["of"])).crossJoin(F.broadcast(every))
    enough = lambda c: F.kll_sketch_get_n_double(c) >= MIN_GROUP
    return levels.select("lang", "source", *[F.when(enough(c), F.col(c)).when(enough(f"lang_{c}"), F.col(f"lang_{c}")).otherwise(F.col(f"all_{c}")).alias(c) for c in SKETCHED])


def fences(measured: DataFrame) -> DataFrame:
    """One row per ``lang`` and ``source`` of ``measured`` with ``<ratio>_low`` and ``<ratio>_high``."""
    quantile = lambda c, q: F.kll_sketch_get_quantile_double(c, F.lit(q))
    limits = []
    for name, size, events in RULES:
        q1, q3 = quantile(name, 0.25), quantile(name, 0.75)
        if size is None:
            reach = SPREAD * F.greatest(q3 - q1, LEAST_RELATIVE * quantile(name, 0.5))
            limits.append((q1 - reach).alias(f"{name}_low"))
        else:
            reach = F.greatest(SPREAD * (q3 - q1), F.lit(events) / F.greatest(quantile(size, 0.5), F.lit(1.0)))
            limits.append(F.lit(float("-inf")).alias(f"{name}_low"))
        limits.append((q3 + reach).alias(f"{name}_high"))
    return _group(measured).select("lang", "source", *limits)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. ``limits`` is a stored table."""
    if limits.count() <= MAX_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    m, f = ratios(measured).alias("m"), limits.alias("f")
    joined = m.join(f, F.col("m.lang").eqNullSafe(F.col("f.lang")) & F.col("m.source").eqNullSafe(F.col("f.source")), "left")
    inside = F.lit(True)
    for name, *_ in RULES:
        # A group without fences has no sound text, so there's nothing to keep in it.
        inside = inside & F.coalesce(F.col(name).between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(False))
    return joined.select(*[F.col(f"m.{c}") for c in measured.columns], base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def measured_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, list[str]]:
    """The stored measures with ``lang``, ``source`` and a struct ``row`` of the columns that pass through, and their names."""
    keep = others(docs, text_col, *MEASURES, "base_failed", "kept")
    packed = pack(docs, keep, lang=named(lang_col), source=named(source_col), text=named(text_col))
    return materialize(_measured(packed), "op2-measures"), keep


def apply(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the text, with measures, ``base_failed`` and ``kept``. Texts are read once."""
    measured, keep = measured_rows(docs, text_col, lang_col, source_col)
    judged = judge(measured, materialize(fences(measured), "op2-fences"))
    return judged.select(*unpack(keep), *MEASURES, "base_failed", "kept")
