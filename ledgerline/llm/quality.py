"""Quality rules by distribution divergence (operator 3), with DataFrame functions alone.

A document's character-class histogram and its common-word histogram are compared with language references by the
Jensen-Shannon distance (square root of the divergence to base 2, from 0 to 1); the nearest language counts. Short
documents have noisy histograms, so each comparison has a minimum length below which it passes. All of it is computed
within the row: no shuffle, no Python, and every text is read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table

# White space that parts words, and symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"

# Character classes and their usual shares in running text (lower-case letters, upper-case letters,
# digits, white space, sentence punctuation, anything else).
CLASSES = {
    "lower": (r"\p{Ll}+", 0.790),
    "upper": (r"\p{Lu}+", 0.025),
    "digit": (r"[0-9]+", 0.003),
    "space": (SPACE, 0.155),
    "stop": (r"""[.,;:'"!?()-]+""", 0.025),
    "other": (None, 0.002),
}

# The most frequent words of each language, most frequent first.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist dem im nicht ein eine als".split(),
    "en": "the of and to a in is that it for was on with this as be by are from at".split(),
    "es": "de la que el en y los se las del un por con no una su para es al lo".split(),
    "fr": "de la le et les des en un du une que pour est qui dans par sur au pas avec".split(),
}
#: Word frequencies fall with the rank: the word of rank r (from 1) has the share ZIPF_SHARE / (r + ZIPF_SHIFT).
ZIPF_SHARE, ZIPF_SHIFT = 0.10, 0.8

#: Base rules: fewest words, and largest percentage of words in repeated windows of three words.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest distances that pass, and the fewest characters and words that are compared.
MAX_CLASS_DISTANCE = 0.24
MAX_WORD_DISTANCE = 0.36
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 100


def word_reference(language: str) -> dict[str, float]:
    return {w: ZIPF_SHARE / (r + ZIPF_SHIFT) for r, w in enumerate(COMMON_WORDS[language], 1)}


def half(p: Column, q: Column | float) -> Column:
    """p log2(p / m) with m the mean of p and q; 0 where p is 0."""
    q = F.lit(q) if isinstance(q, float) else q
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def without(text: Column, pattern: str) -> Column:
    """How many characters of text the pattern matches."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def symbols_and_class_distance(text: Column, words: Column) -> Column:
    """(n_symbols, class_distance) of text, which words are the words of: how many SYMBOLS it holds, and the distance of
    its character-class histogram to the reference, null for an empty text.

    No character is of two classes, nor both a symbol and of a class with a pattern. So each class is taken out of what
    the classes before it leave, which is short once white space and lower-case letters are gone.
    """
    patterns = {name: pattern for name, (pattern, _) in CLASSES.items() if pattern and name != "space"}

    names = [name for name in CLASSES if name == "space" or name in patterns]

    def compared(n: Column) -> Column:
        known = [F.get(n, F.lit(i)) for i in range(len(names))]
        symbols, total = F.get(n, F.lit(len(names))), F.get(n, F.lit(len(names) + 1))
        shares = [k / total for k in known]
        shares.append((total - sum(known[1:], known[0])) / total)
        terms = [half(p, q) + half(F.lit(q), p) for p, (_, q) in zip(shares, CLASSES.values())]
        far = F.when(total > 0, distance(sum(terms[1:], terms[0]) / 2))
        return F.struct(
            symbols.cast("long").alias("n_symbols"), F.when(total >= MIN_CLASS_CHARS, far).alias("class_distance")
        )

    def taken(rest: Column, left: list[str], sizes: dict[str, Column]) -> Column:
        if not left:
            counted = [*(sizes[name] for name in names), without(rest, SYMBOLS), F.char_length(text)]
            return let(F.array(*counted), compared)
        name = left[0]
        return let(
            F.regexp_replace(rest, patterns[name], ""),
            lambda less: taken(less, left[1:], sizes | {name: F.char_length(rest) - F.char_length(less)}),
        )

    return let(
        F.array_join(words, ""),
        lambda solid: taken(solid, list(patterns), {"space": F.char_length(text) - F.char_length(solid)}),
    )


def word_distance(words: Column) -> Column:
    """Distance of the common-word histogram of words to the nearest language; null if there are no words.

    All words that are not in a language's list are one entry of its histogram.
    """
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    found = F.sort_array(F.filter(words, lambda w: w.isin(every)))

    def counted(s: Column) -> Column:
        """(word, count) of the sorted words s."""
        return let(
            F.array_distinct(s),
            lambda d: F.transform(
                d,
                lambda w, i: F.struct(
                    w.alias("w"),
                    (
                        F.coalesce(F.array_position(s, F.get(d, i + 1)), F.size(s) + 1) - F.array_position(s, w)
                    ).alias("n"),
                ),
            ),
        )

    def compared(counts: Column) -> Column:
        total = F.size(words)

        def to(language: str) -> Column:
            reference = word_reference(language)
            shares = F.create_map(*(F.lit(x) for pair in reference.items() for x in pair))
            known = sum(reference.values())

            def add(acc: Column, c: Column) -> Column:
                p = c["n"] / total
                return let(
                    F.try_element_at(shares, c["w"]),
                    lambda q: F.when(q.isNull(), acc).otherwise(
                        F.struct(
                            (acc["d"] + half(p, q) + half(q, p)).alias("d"),
                            (acc["p"] + p).alias("p"),
                            (acc["q"] + q).alias("q"),
                        )
                    ),
                )

            zero = F.struct(*(F.lit(0.0).alias(k) for k in "dpq"))
            # Listed words that the document lacks add their whole share; then the entry of all other words.
            return F.aggregate(
                counts, zero, add,
                lambda a: distance(
                    (a["d"] + (known - a["q"]) + half(1 - a["p"], 1 - known) + half(F.lit(1 - known), 1 - a["p"])) / 2
                ),
            )

        return F.when(total > 0, F.least(*(to(language) for language in COMMON_WORDS)))

    return let(let(found, counted), compared)


def repeated_words(words: Column, hash_of: Callable[..., Column] = F.xxhash64) -> Column:
    """How many of words lie in a window of three words that occurs twice or more among all windows.

    Each window becomes one number, its hash above and its place below; after sorting, windows that share a hash are
    neighbours, and the others are done with. Neighbours' words are compared. Other windows with the same hash may lie
    between them: where three or more share it and the neighbours differ, all of these are compared.
    """

    def marked(n: Column) -> Column:
        low = F.pow(F.lit(2.0), F.ceil(F.log2(n + F.lit(1)))).cast("long") - F.lit(1)  # bits that hold any place

        def places(mask: Column) -> Column:
            window = lambda i: [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]
            packed = F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: hash_of(*window(i)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")),
            )

            def repeats(s: Column, x: Column, j: Column) -> Column:
                shares = lambda y: F.coalesce(x.bitwiseOR(mask) == y.bitwiseOR(mask), F.lit(False))
                place = lambda y: y.bitwiseAND(mask).cast("int")
                equal = lambda y: F.struct(*window(place(x))) == F.struct(*window(place(y)))
                beside = lambda k: F.get(s, j + k)
                near = lambda k: shares(beside(k)) & equal(beside(k))
                three = (shares(beside(-1)) & shares(beside(1))) | shares(beside(-2)) | shares(beside(2))
                anywhere = F.exists(s, lambda y: (y != x) & shares(y) & equal(y))
                return F.when(
                    shares(beside(-1)) | shares(beside(1)),
                    F.when(near(-1) | near(1), F.lit(True)).when(three, anywhere).otherwise(F.lit(False)),
                ).otherwise(F.lit(False))

            def shared(s: Column) -> Column:
                """What of the sorted s has a neighbour between the least and the largest number of its hash."""
                return F.filter(
                    s,
                    lambda x, j: (F.get(s, j + 1) <= x.bitwiseOR(mask))
                    | (F.get(s, j - 1) >= x.bitwiseAND(F.bitwise_not(mask))),
                )

            return let(
                let(F.sort_array(packed), shared),
                lambda s: F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, j: repeats(s, x, j)),
                        lambda x: x.bitwiseAND(mask),
                    )
                ),
            )

        return let(
            let(low, places),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    return F.when(F.size(words) >= 3, let(F.size(words), marked)).otherwise(F.lit(0).cast("long"))


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance,
    base_failed and kept; columns of docs with these names are replaced.

    A null or empty text has no words, no distances (null) and is not kept. Rows that repeat are judged alike;
    other columns may be null. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judged(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return let(
            symbols_and_class_distance(text, words),
            lambda characters: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                characters["n_symbols"].alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
                characters["class_distance"].alias("class_distance"),
                F.when(F.size(words) >= MIN_COMMON_WORDS, word_distance(words)).alias("word_distance"),
            ),
        )

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance")
    # A generator of one row: what is computed there is not computed again where it is used or filtered by.
    found = docs.drop(*names, "base_failed", "kept").select(
        "*", F.inline(F.array(let(F.array_remove(F.split(text, SPACE), ""), judged)))
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (
        F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return found.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & near)


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances are rounded half up to six digits, beyond the order in which they are summed up."""
    found = quality(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    six = {c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("class_distance", "word_distance")}
    return found.withColumns(six)


def oracle_sql() -> str:
    """The query in SQL, with windows and words unnested instead of worked on within the row."""
    half = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END)"
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    quoted = lambda pattern: pattern.replace("'", "''")
    known = {name: share for name, (pattern, share) in CLASSES.items() if pattern}
    counts = ", ".join(f"{count(quoted(CLASSES[name][0]))} AS c_{name}" for name in known)
    shares = {name: f"(c_{name} / CAST(n_chars AS DOUBLE))" for name in known}
    shares["other"] = f"((n_chars - {' - '.join(f'c_{name}' for name in known)}) / CAST(n_chars AS DOUBLE))"
    d = lambda x: f"CAST({x} AS DOUBLE)"
    classes = " + ".join(half(p, d(CLASSES[n][1])) + " + " + half(d(CLASSES[n][1]), p) for n, p in shares.items())
    references = ", ".join(
        f"('{language}', '{word}', {d(repr(q))})" for language in COMMON_WORDS for word, q in word_reference(language).items()
    )
    rest = "(1 - sum(p)), (1 - sum(q))"
    a, b = rest.split(", ")
    six = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
    return f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
part AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM doc),
word AS (
  SELECT rid, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM part),
win AS (
  SELECT rid, i, w, lead(w) OVER (PARTITION BY rid ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS w3
  FROM word),
rep AS (
  SELECT rid, i FROM win WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
cov AS (SELECT rid, count(DISTINCT i + j) AS n_repeat FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY 1),
ref AS (SELECT * FROM (VALUES {references}) r(lang, w, q)),
seen AS (SELECT rid, w, count(*) AS n FROM word WHERE w IN (SELECT w FROM ref) GROUP BY 1, 2),
share AS (
  SELECT part.rid, lang, q, coalesce(n, 0) / CAST(len(words) AS DOUBLE) AS p
  FROM part CROSS JOIN ref LEFT JOIN seen ON seen.rid = part.rid AND seen.w = ref.w
  WHERE len(words) >= {MIN_COMMON_WORDS}),
lang_distance AS (
  SELECT rid, sqrt(greatest(0, (sum({half('p', 'q')} + {half('q', 'p')}) + {half(a, b)} + {half(b, a)}) / 2)) AS x
  FROM share GROUP BY rid, lang),
nearest AS (SELECT rid, min(x) AS word_x FROM lang_distance GROUP BY 1),
cls AS (SELECT rid, length(t) AS n_chars, {counts} FROM doc),
found AS (
  SELECT part.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    {count(quoted(SYMBOLS))} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words,
    CASE WHEN n_chars >= {MIN_CLASS_CHARS} THEN sqrt(greatest(0, ({classes}) / 2)) END AS class_x, word_x
  FROM part JOIN cls USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN nearest USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {six('class_x')} AS class_distance,
  {six('word_x')} AS word_distance, base_failed,
  NOT base_failed AND coalesce(class_x, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_x, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM judged
"""
