"""Scalar functions: known values, nulls and empty strings, and properties over random strings."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.errors import AlgorithmError, ValidationError
from kindred.functions import batches, edit, jaro, kernels, ngrams, phonetic, ratios, sounds
from kindred.functions.namespace import fuzzy
from kindred.functions.normalize import normalize_string
from kindred.functions.registry import Algorithm, lengths_allow, resolve, scorer

def a_b():
    return F.col("a"), F.col("b")


def over(spark, pairs, f):
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    return [r.x for r in df.select("k", f(*a_b()).alias("x")).orderBy("k").collect()]


KNOWN = [
    (edit.levenshtein, "kitten", "sitting", 3),
    (edit.levenshtein, "é", "e", 1),
    (edit.levenshtein_bytes, "é", "e", 2),
    (edit.levenshtein_similarity, "kitten", "sitting", 0.5714),
    (edit.levenshtein_similarity, "saturday", "sunday", 0.625),
    (edit.levenshtein_grapheme, "👨‍👩‍👧x", "x", 1),
    (edit.damerau_levenshtein, "ca", "ac", 1),
    (edit.damerau_levenshtein, "00210000", "001020000", 2),
    (edit.optimal_string_alignment, "00210000", "001020000", 3),
    (edit.hamming, "karolin", "kathrin", 3),
    (edit.hamming, "abc", "ab", None),
    (edit.hamming_distance_padded, "abc", "abxyz", 3),
    (edit.hamming_similarity, "abc", "ab", 0.0),
    (jaro.jaro_similarity, "MARTHA", "MARHTA", 0.9444),
    (jaro.jaro_similarity, "DWAYNE", "DUANE", 0.8222),
    (jaro.jaro_similarity, "hello", "hallo", 0.8667),
    (jaro.jaro_similarity, "algorithm", "altruistic", 0.6185),
    (jaro.jaro_winkler_similarity, "kitten", "sitting", 0.7460),
    (jaro.jaro_winkler_similarity, "saturday", "sunday", 0.7775),
    (ngrams.ngram_similarity, "kitten", "sitting", 0.1176),
    (ngrams.ngram_similarity, "saturday", "sunday", 0.4444),
    (ngrams.bigram_similarity, "night", "nacht", 0.5),
    (ngrams.cosine_similarity_chars, "kitten", "sitting", 0.7462),
    (ngrams.cosine_similarity_chars, "saturday", "sunday", 0.7746),
    (ngrams.cosine_similarity_words, "The cat", "the CAT cat", 0.9487),
    (ngrams.lcs_length, "ABCDGH", "AEDFHR", 3),
    (ngrams.lcs_string, "ABCDGH", "AEDFHR", "ADH"),
    (ngrams.lcs_string, "AGGTAB", "GXTXAYB", "GTAB"),
    (ngrams.longest_common_substring, "abcdef", "zbcdf", "bcd"),
    (ngrams.longest_common_substring_length, "abcdef", "zbcdf", 3),
    (ratios.partial_ratio, "test", "this is a test", 1.0),
    (ratios.token_sort_ratio, "hello world", "world hello", 1.0),
    (ratios.token_set_ratio, "a", "b", 0.5),
    (ratios.token_set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0),
    (ratios.wratio, "", "  ", 0.0),
    (phonetic.soundex_match, "Robert", "Rupert", True),
    (phonetic.soundex_similarity, "Robert", "Rubin", 0.5),
    (phonetic.double_metaphone_match, "Stephen", "Steven", True),
    (phonetic.double_metaphone_match, "Katherine", "Catherine", True),
    (phonetic.double_metaphone_match, "1", "1", False),
]


def test_known_values(spark):
    columns = [f(F.lit(a), F.lit(b)).alias(f"c{k}") for k, (f, a, b, _) in enumerate(KNOWN)]
    row = spark.range(1).select(*columns).first()
    for (f, a, b, want), got in zip(KNOWN, row):
        assert (got == want) if not isinstance(want, float) else abs(got - want) < 6e-5, (f.__name__, a, b, got, want)


@pytest.mark.parametrize("word, code", [("Robert", "R163"), ("Rubin", "R150"), ("Ashcraft", "A261"), ("Ashcroft", "A261"), ("", ""), ("123", ""), (" o'Hara ", "O600")])
def test_soundex(spark, word, code):
    assert spark.range(1).select(phonetic.soundex(F.lit(word)).alias("x")).first().x == code


@pytest.mark.parametrize("word, code", [("phone", "FN"), ("knight", "NT"), ("Thompson", "0MPS"), ("dumb", "TM"), ("Xavier", "SFR"), ("which", "WX"), ("school", "SXL"), ("", ""), ("edge", "EJ"), ("wrack", "RK")])
def test_metaphone(word, code):
    assert sounds.metaphone(word) == code


@pytest.mark.parametrize("word, codes", [("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Jose", ("JS", "HS")), ("Michael", ("MKL", "MXL")), ("caesar", ("SSR", "")), ("Wright", ("RT", "")), ("", ("", "")), ("cough", ("KF", "")), ("accident", ("AKST", "")), ("Czerny", ("SRN", "XRN"))])
def test_double_metaphone(word, codes):
    assert sounds.double_metaphone(word) == codes


PAIR_FUNCTIONS = [
    edit.levenshtein_similarity, edit.damerau_levenshtein_similarity, edit.optimal_string_alignment_similarity, edit.levenshtein_bytes_similarity,
    edit.levenshtein_similarity_grapheme, jaro.jaro_similarity, jaro.jaro_winkler_similarity, jaro.jaro_similarity_grapheme, ngrams.ngram_similarity,
    ngrams.ngram_jaccard, ngrams.ngram_profile_similarity, ngrams.cosine_similarity_chars, ngrams.cosine_similarity_words, ngrams.cosine_similarity_ngrams,
    ngrams.lcs_similarity, ngrams.lcs_similarity_max, ratios.ratio, ratios.partial_ratio, ratios.token_sort_ratio, ratios.token_set_ratio, ratios.wratio, ratios.qratio,
]


def test_nulls_and_empty_strings(spark):
    rows = [(None, "x"), ("x", None), (None, None), ("", ""), ("", "abc"), ("abc", "")]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, p struct<a:string,b:string>").select("k", "p.*")
    got = df.select("k", *[f(*a_b()).alias(f"c{n}") for n, f in enumerate(PAIR_FUNCTIONS)]).orderBy("k").collect()
    for n, f in enumerate(PAIR_FUNCTIONS):
        values = [r[f"c{n}"] for r in got]
        assert values == [None, None, None, 1.0, 0.0, 0.0], (f.__name__, values)


def test_similarities_are_bounded_symmetric_and_one_for_equals(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé xyz") for _ in range(rng.randint(1, 12)))
    pairs = [(word(), word()) for _ in range(80)]
    pairs += [(a, a) for a, _ in pairs[:20] if a.strip()]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    there = df.select("k", *[f(*a_b()).alias(f"c{n}") for n, f in enumerate(PAIR_FUNCTIONS)]).orderBy("k").collect()
    back = df.select("k", *[f(*a_b()[::-1]).alias(f"c{n}") for n, f in enumerate(PAIR_FUNCTIONS)]).orderBy("k").collect()
    for n, f in enumerate(PAIR_FUNCTIONS):
        for (a, b), x, y in zip(pairs, there, back):
            assert -1e-12 <= x[f"c{n}"] <= 1 + 1e-12, (f.__name__, a, b)
            assert abs(x[f"c{n}"] - y[f"c{n}"]) < 1e-9, (f.__name__, a, b)
            assert a != b or abs(x[f"c{n}"] - 1) < 1e-12, (f.__name__, a)


short = st.text(alphabet="abcx", max_size=7)


def plain_distance(a, b, swaps):
    """Levenshtein, with swaps of neighbours, by plain recursion."""
    if not a or not b:
        return len(a) + len(b)
    best = min(plain_distance(a[1:], b, swaps) + 1, plain_distance(a, b[1:], swaps) + 1, plain_distance(a[1:], b[1:], swaps) + (a[0] != b[0]))
    if swaps and len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
        best = min(best, plain_distance(a[2:], b[2:], swaps) + 1)
    return best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abx", max_size=5), st.text(alphabet="abx", max_size=5))
def test_osa_is_the_plain_recursion(a, b):
    assert kernels.osa(a, b) == plain_distance(a, b, True) >= kernels.damerau(a, b)


@settings(max_examples=100, deadline=None)
@given(short, short, short)
def test_damerau_is_a_metric(a, b, c):
    d = kernels.damerau
    assert d(a, a) == 0 and d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c) and (d(a, b) > 0 or a == b)


@settings(max_examples=100, deadline=None)
@given(short, short)
def test_common_parts(a, b):
    s = kernels.lcs_string(a, b)
    assert len(s) == kernels.lcs_length(a, b)
    for whole in (a, b):
        rest = iter(whole)
        assert all(c in rest for c in s)
    t = kernels.common_substring(a, b)
    assert t in a and t in b and not any(a[i : i + len(t) + 1] in b for i in range(len(a) - len(t)))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=12))
def test_codes_have_only_letters_and_stop(s):
    assert len(sounds.metaphone(s, 6)) <= 6 and all(len(c) <= 4 for c in sounds.double_metaphone(s))
    assert sounds.metaphone(s) == sounds.metaphone(s.upper())


def test_long_strings_are_guarded():
    with pytest.raises(ValueError):
        kernels.lcs_string("a" * 10_001, "b")
    with pytest.raises(ValueError):
        kernels.common_substring("a", "b" * 10_001)


def test_bounds(spark):
    pairs = [("kitten", "sitting"), ("abc", "abc"), ("", "abcdef"), (None, "x")]
    assert over(spark, pairs, lambda a, b: edit.levenshtein(a, b, 2)) == [3, 0, 3, None]
    assert over(spark, pairs, lambda a, b: edit.levenshtein_bounded(a, b, 2)) == [None, 0, None, None]
    assert over(spark, pairs, lambda a, b: edit.damerau_levenshtein(a, b, 2)) == [3, 0, 3, None]
    assert over(spark, pairs, lambda a, b: edit.damerau_levenshtein_bounded(a, b, 3)) == [3, 0, None, None]
    assert over(spark, pairs, lambda a, b: edit.optimal_string_alignment(a, b, 1)) == [2, 0, 2, None]


def test_grams(spark):
    row = spark.range(1).select(ngrams.extract_ngrams(F.lit("abc"), 2, False).alias("a"), ngrams.extract_ngrams(F.lit("abc"), 2).alias("b"), ngrams.extract_ngrams(F.lit("a"), 2, False).alias("c"), ngrams.extract_ngrams(F.lit(None).cast("string"), 2).alias("d")).first()
    assert list(row) == [["ab", "bc"], [" a", "ab", "bc", "c "], [], None]


def test_normalisation(spark):
    s = "  Ünï  Code-Ⅳ, ﬁn! "
    modes = {"lowercase": s.lower(), "unicode_nfkd": unicodedata.normalize("NFKD", s), "remove_punctuation": "  Ünï  CodeⅣ ﬁn ", "remove_whitespace": "ÜnïCode-Ⅳ,ﬁn!"}
    row = spark.range(1).select(*[normalize_string(F.lit(s), m).alias(m) for m in [*modes, "strict"]]).first()
    for m, want in modes.items():
        assert row[m] == want, m
    assert row.strict == unicodedata.normalize("NFKD", s).lower().translate(dict.fromkeys(map(ord, "-,!"))).replace(" ", "")
    with pytest.raises(ValidationError):
        normalize_string(F.lit("x"), "uppercase")


def test_length_bounds_lose_no_pair(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for name in ("levenshtein", "damerau_levenshtein", "osa", "jaro", "jaro_winkler", "lcs", "hamming", "exact_match"):
        for t in (0.3, 0.8, 1.0):
            assert df.where((scorer(name)(*a_b()) >= t) & ~lengths_allow(name, t, *a_b())).count() == 0, (name, t)


def test_names():
    assert resolve("Damerau") == "damerau_levenshtein" and resolve(Algorithm.JARO) == "jaro" and resolve("exact") == "exact_match"
    for bad in ("soundslike", "", 3):
        with pytest.raises(AlgorithmError):
            resolve(bad)


def test_namespace(spark):
    df = spark.createDataFrame([(1, "apple", "Apple"), (2, None, "x"), (3, "banana", "bandana")], "k int, a string, b string")
    f, B = fuzzy("a"), F.col("b")
    got = df.select(
        "k", f.similarity(B, "levenshtein").alias("s"), f.similarity(B, case_insensitive=True).alias("i"), f.is_similar("apples", 0.8).alias("y"),
        f.best_match(["aple", "apple", "bananas"]).alias("m"), f.best_match(["zzz"], min_similarity=0.9).alias("n"), f.best_match_score(["x", "apple", "apple"]).alias("ms"),
        f.distance(B).alias("d"), f.distance(B, "lcs").alias("l"), f.phonetic("metaphone").alias("p"), f.normalize("lowercase").alias("low"),
    ).orderBy("k").collect()
    assert [r.m for r in got] == ["apple", None, "bananas"] and [r.n for r in got] == [None] * 3
    assert got[0].i == 1.0 and got[0].ms.score == 1.0 and got[0].y and got[1].y is None and not got[2].y
    assert [r.d for r in got] == [1, None, 1] and [r.l for r in got] == [1, None, 1] and got[2].p == "BNN"
    with pytest.raises(AlgorithmError):
        f.distance(B, "jaro")
    with pytest.raises(AlgorithmError):
        f.phonetic("nysiis")
    with pytest.raises(ValidationError):
        f.is_similar("x", 1.5)


@pytest.mark.parametrize("call", [lambda: edit.levenshtein(*a_b(), -1), lambda: jaro.jaro_winkler_similarity(*a_b(), 0.3), lambda: ngrams.extract_ngrams(F.col("a"), 0), lambda: jaro.jaro_winkler_similarity(*a_b(), float("nan"))])
def test_arguments_are_checked_while_planning(spark, call):
    with pytest.raises(ValidationError):
        call()


def test_tf_idf(spark):
    corpus = spark.createDataFrame([("the cat sat",), ("the dog sat down",), ("a bird",)], "text string")
    pairs = spark.createDataFrame([(1, "the cat", "the cat"), (2, "cat", "dog"), (3, None, "x"), (4, "", ""), (5, "", "x"), (6, "the cat", "the dog")], "k int, a string, b string")
    got = {r.k: r.score for r in ngrams.TfIdfCosine(corpus).similarity(pairs, "k", "a", "b").collect()}
    assert abs(got[1] - 1) < 1e-12 and got[2] == 0 and got[3] is None and got[4] == 1 and got[5] == 0 and 0.2 < got[6] < 0.5
    assert ngrams.TfIdfCosine(corpus).add_documents(corpus).num_documents() == 6


def test_sql_names(spark):
    from kindred.functions.sql import register

    assert "metaphone" in register(spark)
    row = spark.sql("SELECT jaro_winkler_similarity('MARTHA', 'MARHTA') AS j, damerau_levenshtein('ca', 'ac') AS d, metaphone('phone') AS m, lcs_length(null, 'a') AS n").first()
    assert abs(row.j - 0.9611) < 1e-4 and (row.d, row.m, row.n) == (1, "FN", None)


def textbook_damerau(a, b):
    """In quadratic space."""
    far, last = len(a) + len(b), {}
    d = {(-1, -1): far}
    d |= {(i, -1): far for i in range(len(a) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    d |= {(-1, j): far for j in range(len(b) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            row, swap = last.get(b[j - 1], 0), column
            same = a[i - 1] == b[j - 1]
            column = j if same else column
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[row - 1, swap - 1] + i - row + j - swap - 1)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


words_ = st.text(alphabet="abcdé😀", max_size=14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words_, words_), min_size=16, max_size=60))
def test_batches_equal_scalar_kernels(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for batch, scalar in ((batches.jaro, kernels.jaro), (batches.jaro_winkler, kernels.jaro_winkler), (batches.osa, kernels.osa), (batches.damerau, kernels.damerau)):
        assert batches.over(batch, scalar)(a, b) == [scalar(x, y) for x, y in pairs]
    assert batches.over(lambda *x: batches.jaro(*x, False), lambda x, y: kernels.jaro(x, y, False), True)(a, b) == [kernels.jaro(kernels.graphemes(x), kernels.graphemes(y), False) for x, y in pairs]
    assert batches.substrings(a, b) == [kernels.common_substring(x, y) for x, y in pairs]
    assert [kernels.damerau(x, y) for x, y in pairs] == [textbook_damerau(x, y) for x, y in pairs]


def test_batches_of_few_and_of_long_strings():
    r = random.Random(4)
    long = ["".join(r.choice("abc") for _ in range(n)) for n in (300, 257, 2000)]
    pairs = [(x, x[:-3] + "x") for x in long] + [("", ""), ("", "a"), ("ab", "ba")] + [(f"name {k}", f"nmae {k + 1}") for k in range(40)]
    for some in (pairs, pairs[:5], []):
        assert batches.over(batches.osa, kernels.osa)([a for a, _ in some], [b for _, b in some]) == [kernels.osa(a, b) for a, b in some]


def test_checked_distance_refuses_long_strings(spark):
    assert over(spark, [("hello", "hallo"), ("", "abc"), (None, "x")], edit.damerau_levenshtein_checked) == [1, 3, None]
    with pytest.raises(Exception, match="damerau_levenshtein_checked"):
        over(spark, [("a" * 15_000, "test")], edit.damerau_levenshtein_checked)
