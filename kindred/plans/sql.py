"""SQL expressions for DuckDB that state what the functions compute, to check them against."""

from __future__ import annotations


def lev_sim(a: str, b: str) -> str:
    return f"(CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def jaro(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE ELSE jaro_similarity({a}, {b}) END)"


def jaro_winkler(a: str, b: str) -> str:
    same = [f"{a}[1:{k}] = {b}[1:{k}] AND length({a}) >= {k} AND length({b}) >= {k}" for k in range(1, 5)]
    prefix = "(" + " + ".join(f"(CASE WHEN {s} THEN 1 ELSE 0 END)" for s in same) + ")"
    j = jaro(a, b)
    return f"(CASE WHEN {j} = 0 THEN 0.0::DOUBLE ELSE {j} + {prefix} * 0.1::DOUBLE * (1 - {j}) END)"


def grams(s: str, n: int, pad: bool = True) -> str:
    p = f"(repeat(' ', {n - 1}) || {s} || repeat(' ', {n - 1}))" if pad else s
    return f"list_transform(range(1, length({p}) - {n} + 2), lambda i: substr({p}, i, {n}))"


def share(x: str, y: str, rule: str) -> str:
    return f"(CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0::DOUBLE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE {rule} END)"


def dice(a: str, b: str, n: int) -> str:
    x, y = f"list_distinct({grams(a, n)})", f"list_distinct({grams(b, n)})"
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {share(x, y, f'2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y}))')} END)"


def jaccard(a: str, b: str, n: int) -> str:
    x, y = f"list_distinct({grams(a, n)})", f"list_distinct({grams(b, n)})"
    return share(x, y, f"len(list_intersect({x}, {y}))::DOUBLE / (len({x}) + len({y}) - len(list_intersect({x}, {y})))")


def total(items: str, each: str) -> str:
    return f"list_sum(list_transform({items}, lambda g: ({each})::DOUBLE))"


def times(items: str, g: str = "g") -> str:
    return f"len(list_filter({items}, lambda h: h = {g}))"


def profile(a: str, b: str, n: int) -> str:
    x, y = grams(a, n), grams(b, n)
    both = f"coalesce({total(f'list_distinct(list_intersect({x}, {y}))', f'least({times(x)}, {times(y)})')}, 0)"
    return share(x, y, f"{both} / (len({x}) + len({y}) - {both})")


def cosine(x: str, y: str) -> str:
    dot = f"coalesce({total(f'list_distinct(list_intersect({x}, {y}))', f'{times(x)} * {times(y)}')}, 0)"
    norm = lambda z: f"sqrt({total(f'list_distinct({z})', f'{times(z)} * {times(z)}')})"
    return share(x, y, f"least(1.0::DOUBLE, {dot} / ({norm(x)} * {norm(y)}))")


def letters(s: str) -> str:
    return f"list_transform(range(1, length({s}) + 1), lambda i: substr({s}, i, 1))"


def words(s: str) -> str:
    return f"list_filter(string_split({s}, ' '), lambda w: w <> '')"


def partial_ratio(a: str, b: str) -> str:
    short, long = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    windows = f"list_transform(range(1, length({long}) - length({short}) + 2), lambda i: 1.0::DOUBLE - levenshtein({short}, substr({long}, i, length({short})))::DOUBLE / length({short}))"
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE list_max({windows}) END)"


def token_sort(a: str, b: str) -> str:
    return lev_sim(f"array_to_string(list_sort({words(a)}), ' ')", f"array_to_string(list_sort({words(b)}), ' ')")


def token_set(a: str, b: str) -> str:
    x, y = f"list_sort(list_distinct({words(f'lower({a})')}))", f"list_sort(list_distinct({words(f'lower({b})')}))"
    joined = lambda w: f"array_to_string(list_sort({w}), ' ')"
    both, left, right = joined(f"list_intersect({x}, {y})"), f"list_filter({x}, lambda w: NOT list_contains({y}, w))", f"list_filter({y}, lambda w: NOT list_contains({x}, w))"
    with_ = lambda rest: f"(CASE WHEN len({rest}) = 0 THEN {both} ELSE {both} || ' ' || {joined(rest)} END)"
    return f"greatest({lev_sim(both, with_(left))}, {lev_sim(both, with_(right))}, {lev_sim(with_(left), with_(right))}, {lev_sim(joined(x), joined(y))})"


def wratio(a: str, b: str) -> str:
    ratio = f"(greatest(length({a}), length({b}))::DOUBLE / greatest(1, least(length({a}), length({b}))))"
    penalty = f"(CASE WHEN {ratio} > 8 THEN 0.67::DOUBLE WHEN {ratio} > 1.5::DOUBLE THEN 1.0::DOUBLE ELSE 1.056::DOUBLE END)"
    return f"greatest({lev_sim(a, b)}, {partial_ratio(a, b)} * least(1.0::DOUBLE, 0.9::DOUBLE * {penalty}), {token_sort(a, b)} * 0.95::DOUBLE, {token_set(a, b)} * 0.95::DOUBLE)"


def share_gram(a: str, b: str, n: int = 2) -> str:
    """Whether two values are candidates."""
    return f"list_has_any({grams(a, n, False)}, {grams(b, n, False)})"


def clusters(nodes: str, edges: str) -> str:
    """CTEs that give ``cluster(id, root)``: the least id that edges (u, v) lead to. Needs WITH RECURSIVE."""
    return f"""walk(id, root) AS (
  SELECT id, id FROM {nodes}
  UNION
  SELECT w.id, x.o FROM walk w JOIN (SELECT u AS i, v AS o FROM {edges} UNION SELECT v, u FROM {edges}) x ON x.i = w.root
), cluster AS (SELECT id, min(root) AS root, count(*) AS members FROM walk GROUP BY id)"""


def typo(key: str, s: str) -> str:
    """A string with a character dropped, two swapped, one replaced, or as it is; the same text in Spark SQL."""
    return (
        f"CASE {key} % 4 WHEN 0 THEN concat(substr({s}, 1, 1), substr({s}, 3)) WHEN 1 THEN concat(substr({s}, 1, 1), substr({s}, 3, 1), substr({s}, 2, 1), substr({s}, 4)) "
        f"WHEN 2 THEN concat(substr({s}, 1, 2), 'x', substr({s}, 4)) ELSE {s} END"
    )


def lcs(pairs: str) -> str:
    """CTE l(a, b, n, t): the length of the longest common subsequence of each pair, and the subsequence itself; cell by cell. Needs WITH RECURSIVE.

    Of equally good ways the one that drops a character of ``b``.
    """
    return f"""cell(a, b, k, old, new, olds, news) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0::INT), [0::INT], list_transform(range(0, length(b) + 1), lambda x: ''), [''] FROM {pairs}
  UNION ALL
  SELECT a, b, k + 1, o, list_append(c, CASE WHEN x = y THEN o[j] + 1 ELSE greatest(o[j + 1], c[j]) END), os,
    list_append(cs, CASE WHEN x = y THEN os[j] || x WHEN o[j + 1] > c[j] THEN os[j + 1] ELSE cs[j] END)
  FROM (SELECT a, b, k, k % length(b) + 1 AS j, substr(a, k // length(b) + 1, 1) AS x, substr(b, k % length(b) + 1, 1) AS y,
    CASE WHEN k % length(b) = 0 AND k > 0 THEN new ELSE old END AS o, CASE WHEN k % length(b) = 0 THEN [0::INT] ELSE new END AS c,
    CASE WHEN k % length(b) = 0 AND k > 0 THEN news ELSE olds END AS os, CASE WHEN k % length(b) = 0 THEN [''] ELSE news END AS cs
    FROM cell WHERE k < length(a) * length(b))
), l AS (SELECT a, b, new[length(b) + 1]::BIGINT AS n, news[length(b) + 1] AS t FROM cell WHERE k = length(a) * length(b))"""


def osa(pairs: str) -> str:
    """CTE l(a, b, d): optimal string alignment of each pair, cell by cell. Needs WITH RECURSIVE."""
    return f"""cell(a, b, k, older, old, new) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: x::INT), list_transform(range(0, length(b) + 1), lambda x: x::INT), [1::INT] FROM {pairs}
  UNION ALL
  SELECT a, b, k + 1, oo, o, list_append(c, least(o[j + 1] + 1, c[j] + 1, o[j] + CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN 0 ELSE 1 END,
    CASE WHEN i > 1 AND j > 1 AND substr(a, i, 1) = substr(b, j - 1, 1) AND substr(a, i - 1, 1) = substr(b, j, 1) THEN oo[j - 1] + 1 ELSE 1000 END)::INT)
  FROM (SELECT a, b, k, k // length(b) + 1 AS i, k % length(b) + 1 AS j,
    CASE WHEN k % length(b) = 0 AND k > 0 THEN old ELSE older END AS oo, CASE WHEN k % length(b) = 0 AND k > 0 THEN new ELSE old END AS o,
    CASE WHEN k % length(b) = 0 THEN [(k // length(b) + 1)::INT] ELSE new END AS c
    FROM cell WHERE k < length(a) * length(b))
), l AS (SELECT a, b, new[length(b) + 1]::BIGINT AS d FROM cell WHERE k = length(a) * length(b))"""


def jaro_halves(pairs: str) -> str:
    """CTE l(a, b, j): Jaro similarity where an odd number of transposed characters counts a half. Needs WITH RECURSIVE."""
    reach = "greatest(0, greatest(length(a), length(b)) // 2 - 1)"
    return f"""met(a, b, i, used, seen) AS (
  SELECT a, b, 0, []::BIGINT[], '' FROM {pairs}
  UNION ALL
  SELECT a, b, i + 1, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, CASE WHEN hit IS NULL THEN seen ELSE seen || substr(a, i + 1, 1) END
  FROM (SELECT *, list_filter(range(greatest(1, i + 1 - {reach}), least(length(b), i + 1 + {reach}) + 1), lambda j: substr(b, j, 1) = substr(a, i + 1, 1) AND NOT list_contains(used, j))[1] AS hit FROM met WHERE i < length(a))
), l AS (SELECT a, b, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE (m / length(a) + m / length(b) + (m - list_sum(list_transform(range(1, m::BIGINT + 1), lambda k: CASE WHEN substr(seen, k, 1) = substr(b, u[k], 1) THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END))) / m) / 3 END AS j
  FROM (SELECT a, b, seen, list_sort(used) AS u, len(used)::DOUBLE AS m FROM met WHERE i = length(a)))"""


def soundex(s: str) -> str:
    body = f"regexp_replace(upper({s}), '[^A-Z]', '', 'g')"
    codes = f"translate(substr({body}, 1, 1) || regexp_replace(substr({body}, 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for k in range(1, 7):
        codes = f"regexp_replace({codes}, '{k}+', '{k}', 'g')"
    return f"(CASE WHEN {body} = '' THEN '' ELSE substr({body}, 1, 1) || substr(replace(substr({codes}, 2), '0', '') || '000', 1, 3) END)"


def soundex_similarity(x: str, y: str) -> str:
    """Of two codes."""
    return f"(CASE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(1, 5), lambda k: CASE WHEN substr({x}, k, 1) = substr({y}, k, 1) THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)) END)"


def metaphone(names: str) -> str:
    """CTEs that give ``meta(t, code)`` for the strings of ``names`` (t): letter by letter. Needs WITH RECURSIVE."""
    v = "[AEIOU]"
    rules = [  # what precedes, what the rest begins with, the code, letters taken
        ("length(code) >= 4", "", "", 99), ("i = 1", "(KN|GN|PN|AE|WR)", "", 1), ("i = 1", "WH", "W", 2), ("i = 1", "X", "S", 1),
        ("i > 1", v, "", 1), ("p = 'M'", "B$", "", 1), ("true", "CIA", "X", 3), ("true", "CH", "X", 2), ("true", "C[IEY]", "S", 1), ("true", "C", "K", 1),
        ("true", "DG[EIY]", "J", 3), ("true", "D", "T", 1), ("true", "GH[^AEIOU]", "", 2), ("i = 1", "GH", "K", 2), ("true", "GH", "", 1), ("true", "GN[ED]", "K", 1),
        ("true", "GN", "", 1), ("true", "G[IEY]", "J", 1), ("true", "G", "K", 1), (f"p NOT SIMILAR TO '{v}'", f"H{v}", "H", 1), ("true", "H", "", 1), ("p <> 'C'", "K", "K", 1), ("true", "K", "", 1),
        ("true", "PH", "F", 2), ("true", "Q", "K", 1), ("true", "SH", "X", 2), ("true", "SI[OA]", "X", 3), ("true", "TI[OA]", "X", 3), ("true", "TH", "0", 2), ("true", "TCH", "", 1),
        ("true", "V", "F", 1), ("true", f"W{v}", "W", 1), ("true", "W", "", 1), ("true", "X", "KS", 1), ("true", f"Y{v}", "Y", 1), ("true", "Y", "", 1), ("true", "Z", "S", 1),
    ]
    when = lambda k: " ".join(f"WHEN {c} AND regexp_matches(r, '^{p}') THEN {repr(r[k]) if k == 2 else r[k]}" for r in rules for c, p in [r[:2]])
    return f"""walk(t, s, i, code) AS (
  SELECT t, regexp_replace(upper(t), '[^A-Z]', '', 'g'), 1, '' FROM {names}
  UNION ALL
  SELECT t, s, i + CASE {when(3)} ELSE 1 END, code || CASE {when(2)} ELSE substr(r, 1, 1) END FROM (SELECT *, substr(s, i) AS r, CASE WHEN i > 1 THEN substr(s, i - 1, 1) ELSE '' END AS p FROM walk WHERE i <= length(s))
), meta AS (SELECT t, substr(code, 1, 4) AS code FROM walk WHERE i > length(s))"""
