"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base patterns give spans that always stay. Generators of higher recall propose further, overlapping spans; boosted
trees over format and context features score them, and a threshold calibrated for each kind selects. The trees are
trained in numpy on candidates of the documents themselves, labelled by validation, and applied as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and anchors at the start of a run find the same spans without backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with a match passes.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: What the method looks for besides: keys, tokens and passwords in texts.
ALL_KINDS = (*KINDS, "secret")
_AT, _DOT = r"(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?|\x20at\x20)", r"(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\x20dot\x20)"
#: Generators: written-out addresses, addresses with brackets or eight groups, digit groups of any usual form, long runs
#: of letters and digits. They propose far more than is personal.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++|@[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20)[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])(?=[0-9_/+=-]*+[A-Za-z])[A-Za-z0-9_/+=-]{20,}+",
}
WIDE_NEEDS = {"email": r"[\[({]at[\])}]|\x20at\x20|[\[({]dot[\])}]|\x20dot\x20", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9][\[(\x20]", "card": r"[0-9][./_\x20-]{1,2}[0-9]", "phone": r"[0-9][)\x20./-]\x20?[0-9]", "secret": r"[0-9][A-Za-z]|[A-Za-z][0-9]"}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a span that speak for personal data, for a secret, and against.
FOR = r"(?i)(?:phone|tel|call|mobile|fax|cell|mail|contact|reach|write|card|visa|master|amex|pay|ip|host|addr|from|t[ée]l[ée]fon|correo|handy|rufen)[^\n]{0,16}$"
KEY = r"(?i)(?:token|secret|passw|pwd|passphrase|credential|bearer|api|key|auth)[^\n]{0,12}$"
AGAINST = r"(?i)(?:order|version|ver|isbn|issn|serial|part|ref|invoice|no|nr|date|id|sku|page|pp|vol|build|doi|score|commit|sha[0-9]*|md5|digest|checksum)[^A-Za-z\n]{0,6}$"
CONTEXT = 24
FEATURES = ("kind", "digits", "letters", "separators", "kinds_of_separators", "length", "distinct", "luhn", "bytes", "address", "hex", "for", "key", "against", "parenthesis", "plus", "first_group", "year")
#: Items of an array that are scanned at once, and the longest array whose items are all looked at to find one.
BLOCK, SHORT = 64, 16


def scan_sql(x: str, op: str, levels: int = 2) -> str:
    """SQL of the running results of `op` ({a} with {b}) over an array of whole numbers from 0: block by block, then over
    the blocks' last ones. An array grows by copying, so blocks bound what is copied; the work is linear up to arrays of
    millions. An array of one binds a value that is used more than once."""
    within = lambda a: f"aggregate({a}, cast(array() as array<int>), (acc, v) -> concat(acc, array({op.format(a='coalesce(try_element_at(acc, -1), 0)', b='v')})))"
    if not levels:
        return within(x)
    a, k, t = (f"{name}{levels}" for name in ("all", "blocks", "sums"))
    blocks = f"transform(sequence(0, cast(floor((size({a}) - 1) / {BLOCK}) as int)), at -> {within(f'slice({a}, at * {BLOCK} + 1, {BLOCK})')})"
    before = f"transform(array({scan_sql(f'transform({k}, b -> element_at(b, -1))', op, levels - 1)}), {t} -> concat(array(0), slice({t}, 1, size({t}) - 1)))[0]"
    joined = f"transform(array({blocks}), {k} -> flatten(zip_with({k}, {before}, (b, o) -> transform(b, v -> {op.format(a='o', b='v')}))))[0]"
    return f"transform(array({x}), {a} -> case when size({a}) > 0 then {joined} else cast(array() as array<int>) end)[0]"


def _meets_sql(spans: str, s: str) -> str:
    """Whether s overlaps one of some spans that are in order and apart from each other: the last that begins before it
    ends is the only one that can, and is found by halving."""
    half = "cast(floor((r.low + r.high) / 2) as int)"
    step = f"case when r.low >= r.high then r when {spans}[{half}].start < {s}.end then named_struct('low', {half} + 1, 'high', r.high) else named_struct('low', r.low, 'high', {half}) end"
    last = f"transform(array(aggregate(sequence(1, 31), named_struct('low', 0, 'high', size({spans})), (r, z) -> {step}, r -> r.low)), n -> n > 0 and get({spans}, n - 1).end > {s}.start)[0]"
    return f"case when size({spans}) <= {SHORT} then exists({spans}, b -> b.start < {s}.end and {s}.start < b.end) else {last} end"


def _best_apart(rows: DataFrame, candidates: str, name: str) -> DataFrame:
    """Adds `name` (start, k, end): of overlapping candidates (start, k, end, loss) those of least loss that don't
    overlap a better one, in order. Only candidates of one stretch, whose spans hang together, are compared."""
    plain = "s -> named_struct('start', s.start, 'k', s.k, 'end', s.end)"
    by_loss = "array_sort(transform(part, s -> named_struct('loss', s.loss, 'start', s.start, 'k', s.k, 'end', s.end)))"
    chosen = f"aggregate({by_loss}, cast(array() as array<struct<loss:double,start:int,k:int,end:int>>), (acc, s) -> case when exists(acc, b -> s.start < b.end and b.start < s.end) then acc else concat(acc, array(s)) end)"
    rows = rows.withColumn("__all", F.array_sort(candidates)).withColumn("__reach", F.expr(scan_sql("transform(__all, s -> s.end)", "greatest({a}, {b})")))
    rows = rows.withColumn("__opens", F.expr("case when size(__all) > 0 then filter(sequence(0, size(__all) - 1), i -> i = 0 or get(__all, i).start >= get(__reach, i - 1)) else cast(array() as array<int>) end"))
    stretches = "transform(zip_with(__opens, concat(slice(__opens, 2, size(__opens)), array(size(__all))), (a, b) -> named_struct('a', a, 'b', b)), p -> slice(__all, p.a + 1, p.b - p.a))"
    best = f"flatten(transform({stretches}, part -> case when size(part) = 1 then transform(part, {plain}) else transform({chosen}, {plain}) end))"
    return rows.withColumn(name, F.expr(f"case when size(__all) > 0 then array_sort({best}) else cast(array() as array<struct<start:int,k:int,end:int>>) end")).drop("__all", "__reach", "__opens")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    digit = lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48
    term = lambda i: F.when(F.pmod(n - i, F.lit(2)) == 0, digit(i)).otherwise(F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
    return (n > 0) & (F.pmod(F.aggregate(at, F.lit(0), lambda s, i: s + term(i)), F.lit(10)) == 0)


def _valid(kind: str, span: Column) -> Column:
    """What a base match must also be."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return span.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, needs: str) -> Column:
    return F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _pairs(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (gap, span, size): each match and the text between it and the one before."""
    sized = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("span"), F.length(m).alias("size")))
    return F.when(F.size(matches) > 0, sized).otherwise(F.array().cast("array<struct<gap:string,span:string,size:int>>"))


def _spans(pairs: str, context: bool = False) -> Column:
    """Array of (start, end, span) of the leftmost non-overlapping matches (a column of _pairs), in code points; with
    context also `before`, up to CONTEXT characters before the span."""
    ends = scan_sql(f"transform({pairs}, p -> length(p.gap) + p.size)", "{a} + {b}")
    placed = f"zip_with({ends}, {pairs}, (e, p) -> named_struct('start', e - p.size, 'end', e, 'span', p.span))"
    if not context:
        return F.expr(placed)
    own = f"transform({pairs}, (p, i) -> right(concat(case when i > 0 then right(get({pairs}, i - 1).span, {CONTEXT}) else '' end, right(p.gap, {CONTEXT})), {CONTEXT}))"
    # a piece has a character at least, so that CONTEXT pieces are enough
    back = f"transform(array({own}), t -> transform(t, (x, i) -> case when length(x) >= {CONTEXT} then x else right(array_join(slice(t, greatest(i - {CONTEXT - 2}, 1), least(i + 1, {CONTEXT})), ''), {CONTEXT}) end))[0]"
    return F.expr(f"zip_with({placed}, {back}, (s, b) -> named_struct('start', s.start, 'end', s.end, 'span', s.span, 'before', b))")


def _plain(kind: str, span: Column) -> Column:
    """A span without what hides it: written-out signs, brackets."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(span, _AT, "@"), _DOT, ".")
    if kind == "ip":
        return F.regexp_replace(span, r"\x20?[\[(]?(?:\.|dot)[\])]?\x20?", ".")
    return span


# --- training -----------------------------------------------------------------------------------------------------

_VARIANT = "array<struct<span:string,before:string,good:boolean>>"


def _variants(kind: str, span: Column, before: Column) -> Column:
    """Labelled candidates from one of the corpus: itself, labelled by validation, and if it is valid, the same hidden in
    other ways of writing, in contexts that speak for or against it, and spoilt so that it is valid no longer."""
    one = lambda s, b, good: F.struct(s.alias("span"), b.alias("before"), good.alias("good"))
    yes, no, plain = F.lit(True), F.lit(False), _plain(kind, span)
    told, other = F.lit("you can contact me: "), F.lit("order no. ")
    digits = F.regexp_replace(span, "[^0-9]", "")
    if kind == "email":
        valid = plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
        hidden = [F.replace(plain, F.lit("@"), F.lit(x)) for x in ("[at]", " (at) ", " at ")]
        more = [one(F.regexp_replace(h, r"\.([A-Za-z]+)$", d), b, yes) for h in hidden for d in (".$1", " [dot] $1", " dot $1") for b in (before, told)]
        more += [one(F.regexp_replace(h, r"\.[A-Za-z]+$", ".5"), before, no) for h in hidden]
    elif kind == "ip":
        valid = _valid("ip", plain) | (plain.rlike("^[0-9A-Fa-f:]+$") & plain.rlike("[0-9].*[A-Fa-f]|[A-Fa-f].*[0-9]"))
        more = [one(F.replace(plain, F.lit("."), F.lit(x)), b, yes) for x in ("[.]", "(.)", "[dot]") for b in (before, F.lit("from host "))]
        more += [one(F.regexp_replace(F.replace(plain, F.lit("."), F.lit("[.]")), "^[0-9]+", x), before, no) for x in ("512", "999")]
        more += [one(F.lit("01:23:45:12:30:59:10:11"), before, no), one(F.lit("2001:0db8:85a3:0042:1000:8a2e:0370:7334"), before, yes)]
    elif kind == "card":
        valid = _valid("card", span)
        grouped = [F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{x}") for x in (".", "/", "_", "--", " - ")]
        last = F.substring(digits, -1, 1).cast("int")
        spoilt = F.concat(F.regexp_replace(digits, "[0-9]$", ""), F.pmod(last + 1, F.lit(10)).cast("string"))
        more = [one(g, b, yes) for g in grouped for b in (before, told)]
        more += [one(F.regexp_replace(spoilt, "([0-9]{4})(?=[0-9])", f"$1{x}"), b, no) for x in (".", "/", "_", " ") for b in (before, other)]
    elif kind == "phone":
        valid = _valid("phone", span) & span.startswith("+")
        national = F.concat(F.lit("("), F.substring(digits, -10, 3), F.lit(") "), F.substring(digits, -7, 3), F.lit("-"), F.substring(digits, -4, 4))
        forms = [national, F.regexp_replace(national, r"[()]", ""), F.regexp_replace(F.regexp_replace(national, r"[()]", ""), "[ -]", "."), F.concat(F.lit("001 "), F.regexp_replace(national, r"[()]", ""))]
        more = [one(f, b, yes) for f in forms[:2] for b in (before, told)] + [one(f, told, yes) for f in forms]
        more += [one(f, b, no) for f in forms for b in (other, F.lit("version "))]
        more += [one(F.regexp_replace(f, "^[(]?[0-9]{3}", "2019"), before, no) for f in forms[1:2]]
    else:
        valid = before.rlike(KEY) & (F.size(F.array_distinct(F.split(span, ""))) >= 10) & ~before.rlike(AGAINST)
        more = [one(span, F.lit("password: "), yes), one(span, F.lit("the commit "), no), one(span, F.lit("sha256: "), no), one(F.concat(F.repeat(F.lit("a1"), 12)), F.lit("token = "), no)]
    return F.concat(F.array(one(span, before, valid)), F.when(valid, F.array(*more)).otherwise(F.array().cast(_VARIANT)))


def _candidates(rows: DataFrame) -> DataFrame:
    """(kind, span, before): all spans that base patterns and generators propose in rows (text)."""
    sources = [(k, n, p[k], needs[k]) for k in ALL_KINDS for n, p, needs in (("hit", BASE, NEEDS), ("far", WIDE, WIDE_NEEDS)) if k in p]
    wide = rows.select("text", *(_matches(F.col("text"), p, need).alias(f"{n}_{k}") for k, n, p, need in sources))
    paired = wide.select(*(_pairs(F.col("text"), p, F.col(f"{n}_{k}")).alias(f"pairs_{n}_{k}") for k, n, p, _ in sources))
    spans = paired.select(*(_spans(f"pairs_{n}_{k}", context=True).alias(f"{n}_{k}") for k, n, _, _ in sources))
    named = [F.expr(f"transform({n}_{k}, s -> named_struct('kind', '{k}', 'span', s.span, 'before', s.before))") for k, n, _, _ in sources]
    return spans.select(F.explode(F.concat(*named)).alias("c")).select("c.*")


def training_rows(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of variants of at most `most` different candidates of rows (text), those with the least hashes.

    One that is repeated counts once, so that its copies don't take the place of all others."""
    some = _candidates(rows).distinct().orderBy(F.xxhash64("kind", "span", "before"), "kind", "span", "before").limit(most)
    variants = F.lit(None).cast(_VARIANT)
    for k in ALL_KINDS:
        variants = F.when(F.col("kind") == k, _variants(k, F.col("span"), F.col("before"))).otherwise(variants)
    each = some.select("kind", F.explode(variants).alias("v"))
    values = F.lit(None).cast("array<double>")
    for k in ALL_KINDS:
        values = F.when(F.col("kind") == k, F.array(*(c.cast("double") for c in _feature_columns(k, F.col("v.span"), F.col("v.before"))))).otherwise(values)
    found = each.select(values.alias("x"), F.col("v.good").cast("double").alias("y")).toArrow()
    x = found.column("x").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(found) else np.zeros((0, len(FEATURES)))
    y = found.column("y").to_numpy()
    order = np.lexsort((y, *x.T))  # the same trees, however rows come in
    return x[order], y[order]


def fit_kinds(x: np.ndarray, y: np.ndarray) -> dict[str, tuple[list, float, float]]:
    """Trees, their start and the threshold of each kind."""
    return {kind: fit_trees(x[x[:, 0] == k], y[x[:, 0] == k]) for k, kind in enumerate(ALL_KINDS)}


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 16, depth: int = 3, rate: float = 0.5, precision: float = 0.98, seed: int = 11) -> tuple[list, float, float]:
    """Boosted trees on log loss, their start, and a threshold with enough precision on held-out rows.

    Without good rows or without good held-out ones the threshold is infinite: nothing is selected."""
    n = len(y)
    if n < 40 or y.min() == y.max():
        return [], 0.0, float("inf")
    mixed = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    x, y = x[mixed], y[mixed]
    cut = n * 3 // 4
    start = float(np.log((y[:cut].mean() + 1e-6) / (1 - y[:cut].mean() + 1e-6)))

    edges = [np.unique(np.quantile(x[:cut, f], np.linspace(0, 1, 17)[:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # code <= j: x <= edges[j]

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-3, None, None)
        if left and len(at) >= 20:
            for f, e in enumerate(edges):
                of = codes[f, at]
                sums = [np.cumsum(np.bincount(of, weights=w, minlength=len(e) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at)))]
                fits = (sums[2] >= 5) & (sums[2] <= len(at) - 5)
                gain = np.where(fits, sums[0] ** 2 / (sums[1] + 1.0) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + 1.0) - total_g**2 / (total_h + 1.0), 0.0)
                j = int(gain.argmax())
                best = max(best, (float(gain[j]), f, j), key=lambda b: b[0])
        if best[1] is None:
            return float(rate * total_g / (total_h + 1.0))
        low = codes[best[1], at] <= best[2]
        return (best[1], float(edges[best[1]][best[2]]), grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1))

    score, trees = np.full(n, start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(cut), y - p, p * (1 - p), depth))
        score += tree_values(trees[-1], x)
    held = np.arange(cut, n)
    held = held[np.argsort(-score[held], kind="stable")]
    right = np.cumsum(y[held]) / np.arange(1, len(held) + 1)
    # ties share a score, so only the last of them counts
    enough = np.flatnonzero((right >= precision) & np.append(np.diff(score[held]) < 0, True))
    if not len(enough):
        return trees, start, float("inf")
    last = enough[-1]
    below = score[held[last + 1]] if last + 1 < len(held) else -np.inf
    return trees, start, float(max((score[held[last]] + below) / 2, 0.0))  # midway to the first that is left out


def tree_values(tree, x: np.ndarray) -> np.ndarray:
    """The value of a tree for each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], tree_values(tree[2], x), tree_values(tree[3], x))


# --- application --------------------------------------------------------------------------------------------------


def _feature_columns(kind: str, span: Column, before: Column) -> list[Column]:
    plain = _plain(kind, span)
    digits = F.regexp_replace(plain, "[^0-9]", "")
    seps = F.regexp_replace(span, "[0-9A-Za-z]", "")
    groups = F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    kinds = lambda c: F.size(F.array_distinct(F.split(c, ""))) - F.when(c == "", 1).otherwise(0)
    small = (F.size(groups) == 4) & F.forall(groups, lambda g: F.coalesce(g.try_cast("long"), F.lit(999)) < 256)
    address = plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    return [F.lit(float(ALL_KINDS.index(kind))), F.length(digits), F.length(F.regexp_replace(plain, "[^A-Za-z]", "")), F.length(seps), kinds(seps), F.length(span), kinds(plain), flag(F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)), flag(small), flag(address), flag(plain.rlike("^[0-9A-Fa-f:]+$")), flag(before.rlike(FOR)), flag(before.rlike(KEY)), flag(before.rlike(AGAINST)), flag(span.contains("(")), flag(span.startswith("+")), F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)), flag(span.rlike(r"^(?:19|20)[0-9]{2}[^0-9]"))]


def tree_sql(tree, values: str) -> str:
    """SQL of a tree over an array of features."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"case when {values}[{tree[0]}] <= {tree[1]!r}D then {tree_sql(tree[2], values)} else {tree_sql(tree[3], values)} end"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_candidates: int = 4000) -> DataFrame:
    """One row per input row: id, counts of the base spans of each kind, base_sha256, spans; n_added, n_secrets, secrets
    and personal (whether there is any span or secret).

    `spans` is the comma-joined kind:start:end of base spans and selected candidates, by start, then kind; base_sha256
    is the digest of the same string of base spans only; `secrets` are keys, tokens and passwords, written likewise. Of
    overlapping candidates the one with the best score is taken, none that overlaps a base span. The trees are fitted on
    at most `most_candidates` candidates of these documents (those with the least hashes), labelled by validation. Null
    and empty texts have no spans. Repeated rows and null ids are treated like others; texts may be of any length that
    fits a task; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fitted = fit_kinds(*training_rows(rows.select("text"), most_candidates))
    hits = rows.select("*", *(_matches(F.col("text"), p[k], needs[k]).alias(f"{n}_{k}") for k in ALL_KINDS for n, p, needs in (("hit", BASE, NEEDS), ("far", WIDE, WIDE_NEEDS)) if k in p))
    sources = [(k, n, p[k], to) for k in ALL_KINDS for n, p, to in (("hit", BASE, "raw"), ("far", WIDE, "wide")) if k in p]
    paired = hits.select("id", *(_pairs(F.col("text"), p, F.col(f"{n}_{k}")).alias(f"pairs_{n}_{k}") for k, n, p, _ in sources))
    found = paired.select("id", *(_spans(f"pairs_{n}_{k}", to == "wide").alias(f"{to}_{k}") for k, n, _, to in sources))
    order = lambda k, s: F.struct(s.start.alias("start"), F.lit(ALL_KINDS.index(k)).alias("k"), s.end.alias("end"))
    base_of = lambda k: F.transform(F.filter(f"raw_{k}", lambda s: _valid(k, s.span)), lambda s: order(k, s))
    base = found.select("id", *(base_of(k).alias(f"base_{k}") for k in KINDS), *(f"wide_{k}" for k in ALL_KINDS))
    base = base.withColumn("base", F.array_sort(F.concat(*(F.col(f"base_{k}") for k in KINDS))))

    # the base spans of a kind are in order and apart
    free = lambda k: F.expr(f"filter(wide_{k}, s -> not ({' or '.join(_meets_sql(f'base_{b}', 's') for b in KINDS)}))")
    features = lambda k: lambda s: F.struct(F.array(*(c.cast("double") for c in _feature_columns(k, s.span, s.before))).alias("v"), s.start.alias("start"), s.end.alias("end"))
    used = [k for k in ALL_KINDS if fitted[k][2] < float("inf")]
    # features are computed once for a candidate, then all trees read them
    each = base.withColumns({f"each_{k}": F.transform(free(k), features(k)) for k in used})

    def scored(k: str) -> Column:
        trees, start, threshold = fitted[k]
        score = " + ".join([f"{start!r}D", *(tree_sql(t, "c.v") for t in trees)])
        return F.expr(f"filter(transform(each_{k}, c -> named_struct('start', c.start, 'k', {ALL_KINDS.index(k)}, 'end', c.end, 'loss', -({score}))), s -> s.loss <= {-threshold!r}D)")

    empty = F.array().cast("array<struct<start:int,k:int,end:int,loss:double>>")
    more = _best_apart(each.withColumn("more", F.concat(empty, *(scored(k) for k in used))), "more", "apart")
    secret = ALL_KINDS.index("secret")
    more = more.withColumns({"secrets": F.array_sort(F.filter("apart", lambda s: s.k == secret)), "added": F.filter("apart", lambda s: s.k != secret)})
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, ALL_KINDS)), s.k + 1), F.lit(":"), s.start, F.lit(":"), s.end)), ",")
    spans = F.array_sort(F.concat("base", "added"))
    return more.select(F.col("id").alias(id_col), *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"), text_of(spans).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size("secrets").cast("long").alias("n_secrets"), text_of(F.col("secrets")).alias("secrets"), (F.size("base") + F.size("apart") > 0).alias("personal"))
