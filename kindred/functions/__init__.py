"""Column functions by name."""

from kindred.functions.edit import (
    damerau_levenshtein,
    damerau_levenshtein_bounded,
    damerau_levenshtein_checked,
    damerau_levenshtein_similarity,
    edit_distance,
    hamming,
    hamming_distance_padded,
    hamming_similarity,
    levenshtein,
    levenshtein_bounded,
    levenshtein_bytes,
    levenshtein_bytes_bounded,
    levenshtein_bytes_similarity,
    levenshtein_grapheme,
    levenshtein_similarity,
    levenshtein_similarity_grapheme,
    optimal_string_alignment,
    optimal_string_alignment_similarity,
)
from kindred.functions.jaro import (
    jaro_distance,
    jaro_similarity,
    jaro_similarity_grapheme,
    jaro_winkler_distance,
    jaro_winkler_similarity,
    jaro_winkler_similarity_grapheme,
    similarity,
)
from kindred.functions.namespace import fuzzy
from kindred.functions.ngrams import (
    TfIdfCosine,
    bigram_similarity,
    cosine_similarity_chars,
    cosine_similarity_ngrams,
    cosine_similarity_words,
    extract_ngrams,
    lcs_length,
    lcs_similarity,
    lcs_similarity_max,
    lcs_string,
    longest_common_substring,
    longest_common_substring_length,
    ngram_jaccard,
    ngram_profile_similarity,
    ngram_similarity,
    trigram_similarity,
)
from kindred.functions.normalize import normalize_pair, normalize_string
from kindred.functions.phonetic import (
    double_metaphone,
    double_metaphone_match,
    double_metaphone_similarity,
    metaphone,
    metaphone_match,
    metaphone_similarity,
    soundex,
    soundex_match,
    soundex_similarity,
)
from kindred.functions.ratios import partial_ratio, qratio, qwratio, ratio, token_set_ratio, token_sort_ratio, wratio
from kindred.functions.registry import Algorithm, resolve, scorer

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("edit", "jaro", "namespace", "ngrams", "normalize", "phonetic", "ratios", "registry", "kernels", "vectorised", "sounds")]
