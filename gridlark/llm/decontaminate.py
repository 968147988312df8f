"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question asked again with other values has the same
template. Windows of template words are hashed and joined; for the pairs found, the share of the item's windows in the
whole document is taken, and slot values must map consistently from the item to the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import mark_members, scratch, without

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Units that are taken for slots after a number.
UNITS = "kg g mg km m cm mm mi ft in lb lbs oz l ml s sec secs min mins h hr hrs hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent usd eur gbp mph kph kmh meters meter metres metre kilometers kilometres miles mile feet foot inches inch pounds pound grams gram kilograms liters litres liter litre degrees degree watts watt volts volt"
#: Words that are no names where they stand capitalised, as at the start of a sentence.
NO_NAMES = "I The A An This That These Those He She It They We You His Her Its Their My Our Your If How What When Where Which Who Why In On At For From To Of And But Or So As By With After Before Then There Each Every Some All No Is Are Was Were Do Does Did Can"
#: The same in German, French and Spanish.
NO_NAMES_ELSEWHERE = "Der Die Das Den Dem Des Ein Eine Einen Einem Einer Ich Er Sie Es Wir Ihr Wenn Wie Was Wann Wo Wer Warum In Im Am Auf Für Von Zu Zum Und Aber Oder So Mit Nach Vor Dann Jeder Jede Alle Kein Keine Ist Sind War Hat Haben Le La Les Un Une Des Du De Je Tu Il Elle Nous Vous Ils Elles Ce Cette Ces Si Comment Quel Quelle Quand Qui Pourquoi Dans Sur Pour Par Et Mais Ou Avec Après Avant Alors Chaque Tout Tous Est Sont El Los Las Una Unos Yo Él Ella Nosotros Ellos Este Esta Estos Cómo Qué Cuál Cuándo Quién Por En Con Para Pero Cada Todo Todos Es Son"
#: Numbers written as words, in English, German, French and Spanish; those that are articles too are left out.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil"
)
#: Items that may share a window before it is looked up for those of them only that can't be told without it.
MOST_ITEMS = 64
#: Windows of benchmark items that may be broadcast (16 bytes each); above, the join shuffles.
MOST_BROADCAST = 1 << 21


def _number_words() -> str:
    """A pattern of the words of NUMBER_WORDS, in any case, by first letter so that most words fail at once."""
    by_letter: dict[str, list[str]] = {}
    for w in dict.fromkeys(NUMBER_WORDS.split(" ")):
        by_letter.setdefault(w[0], []).append(w[1:])
    one = "(?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in by_letter.items()) + ")"
    return rf"(?iu)(?<![\p{{L}}\p{{N}}'’-]){one}(?:-{one})*+(?![\p{{L}}\p{{N}}'’-])"


def template_words(text: Column) -> Column:
    """Words of the template: placeholders for slots, the rest in lower case without punctuation.

    Slots are numbers, in digits or as words, units after them, and names: words of two letters or more that begin with
    a capital, with inner capitals, hyphens and apostrophes. Names in lower case are not told from other words."""
    text = F.regexp_replace(_free(text), _number_words(), NUMBER)
    # the first test fails at most characters, so the others are seldom made
    text = F.regexp_replace(text, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?!(?:{f'{NO_NAMES} {NO_NAMES_ELSEWHERE}'.replace(' ', '|')})(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}++|(?=['’]\p{{L}}))(?:['’-]\p{{L}}++)*+", NAME)
    text = F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"[0-9](?:[0-9]|[.,:/](?=[0-9]))*+", NUMBER)).otherwise(text)
    text = F.when(text.contains(f"{NUMBER} "), F.regexp_replace(text, rf"(?i){NUMBER} (?:{UNITS.replace(' ', '|')})\b", f"{NUMBER} {UNIT}")).otherwise(text)
    return _words(F.regexp_replace(text, r"[^\p{L}\p{N}\s\x{E000}-\x{E002}]+", ""))


def plain_words(text: Column) -> Column:
    """The words themselves, one for each template word."""
    return _words(F.regexp_replace(_free(text), r"[^\p{L}\p{N}\s]+", ""))


def _free(text: Column) -> Column:
    """The text without characters that stand for slots; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(NUMBER) | text.contains(NAME) | text.contains(UNIT), F.regexp_replace(text, r"[\x{E000}-\x{E002}]", "")).otherwise(text)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def window(words: Column, start: Column, width: int, kind: str) -> Column:
    """The hash of the `width` words from `start` on."""
    return F.xxhash64(F.lit(kind), *(F.get(words, start + k) for k in range(width)))


def windows(words: Column, width: int, kind: str) -> Column:
    """Hashes of all windows of `width` words."""
    return F.transform(_starts(width, F.size(words)), lambda i: window(words, i, width, kind))


def _starts(width: int, n: Column) -> Column:
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 5, share: float = 0.8) -> DataFrame:
    """(id, item_id, template_share, plain_share, n_slots, n_changed, consistent): documents that hold a benchmark item.

    An item is held if `share` or more of its windows of `width` words are in the document, or of its template's
    windows if no slot value of the item stands for two different values in the document. Items under `width` words
    and null ids, items or texts match nothing. All windows of documents are looked up, of templates and of the words
    themselves; pairs with fewer common windows than either share asks for are not compared."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), template_words(F.col("text")).alias("it"), plain_words(F.col("text")).alias("ip"))
    items = scratch(items.withColumns({"iw": windows(F.col("it"), width, "t"), "ipw": windows(F.col("ip"), width, "p")}).where(F.size("iw") > 0))
    n_windows = items.agg(F.sum(F.size("iw"))).first()[0]
    # both kinds of windows; a share asks for so many different ones
    sides = [items.select("item_id", F.array_distinct(w).alias("w")) for w in ("iw", "ipw")]
    lookup = sides[0].withColumn("kind", F.lit(0)).union(sides[1].withColumn("kind", F.lit(1)))
    lookup = lookup.select("item_id", "kind", (F.size("w") * F.lit(share) - 1e-6).alias("least"), F.explode("w").alias("h"))
    # a window that very many items have, as one of slots alone, is looked up for an item only if what is left of its
    # windows can't show that it may be held: all pairs of its documents and items are not made
    spread = lookup.groupBy("kind", "h").agg((F.count(F.lit(1)) > MOST_ITEMS).alias("common"))
    marked = lookup.join(spread, ["kind", "h"])
    fewer = marked.groupBy("item_id", "kind").agg(F.count(F.when(F.col("common"), 1)).alias("f"))
    lookup = marked.join(fewer, ["item_id", "kind"]).withColumn("spare", F.col("least") - F.col("f") >= 1).where("not common or not spare")
    lookup = scratch(lookup.select("item_id", "kind", "h", F.when(F.col("spare"), F.col("least") - F.col("f")).otherwise(F.col("least")).alias("least")))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the generator names both columns of words, so that generated code makes them once a text and not once a window
    words = texts.select("id", template_words(F.col("text")).alias("it"), plain_words(F.col("text")).alias("ip"))
    starts = words.select("id", "it", "ip", F.explode(_starts(width, F.least(F.size("it"), F.size("ip")))).alias("i"))
    seen = starts.select("id", F.explode(F.array(window(F.col("it"), F.col("i"), width, "t"), window(F.col("ip"), F.col("i"), width, "p"))).alias("h"))
    if 2 * (n_windows or 0) <= MOST_BROADCAST:
        lookup = F.broadcast(lookup)
    else:
        seen = mark_members(seen, "h", scratch(lookup.select("h").distinct()), "maybe").where("maybe").select("id", "h")
    common = seen.join(lookup, "h").groupBy("id", "item_id", "kind").agg(F.count_distinct("h").alias("c"), F.min("least").alias("least"))
    pairs = scratch(common.where("c >= least").select("id", "item_id").distinct())
    some = mark_members(texts, "id", pairs.select("id"), "wanted").where("wanted").drop("wanted").join(pairs.select("id").distinct(), "id", "left_semi")
    some = some.select("id", template_words(F.col("text")).alias("dt"), plain_words(F.col("text")).alias("dp"))
    some = some.withColumns({"dw": windows(F.col("dt"), width, "t"), "dpw": windows(F.col("dp"), width, "p")})
    both = some.join(pairs, "id").join(items, "item_id")
    part = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))
    both = both.withColumns({"template_share": part(F.col("iw"), F.col("dw")), "plain_share": part(F.col("ipw"), F.col("dpw"))}).where(F.greatest("template_share", "plain_share") >= share)
    # the item's place: the shift that most of its windows have
    shifts = F.filter(F.transform(F.sequence(F.lit(1), F.size("iw")), lambda i: F.when(F.array_contains("dw", F.get("iw", i - 1)), F.array_position("dw", F.get("iw", i - 1)) - i)), lambda s: s.isNotNull())
    count = lambda s: F.size(F.filter(F.col("shifts"), lambda t: t == s))
    both = both.withColumn("shifts", shifts).withColumn("shift", F.array_max(F.transform(F.array_distinct("shifts"), lambda s: F.struct(count(s).alias("c"), s.alias("s"))))["s"].cast("int"))
    slot = lambda i: F.get("it", i).isin(NUMBER, NAME, UNIT) & (F.get("it", i) == F.get("dt", i + F.col("shift")))
    value = lambda i: F.struct(F.get("ip", i).alias("a"), F.get("dp", i + F.col("shift")).alias("b"))
    places = F.filter(F.sequence(F.lit(0), F.size("it") - 1), lambda i: (i + F.col("shift") >= 0) & slot(i))
    both = both.withColumn("values", F.array_distinct(F.transform(places, value)))
    both = both.withColumns({"n_slots": F.size("values").cast("long"), "n_changed": F.size(F.filter("values", lambda v: v.a != v.b)).cast("long"), "consistent": F.size(F.array_distinct(F.transform("values", lambda v: v.a))) == F.size("values")})
    return both.where((F.col("plain_share") >= share) | F.col("consistent")).select("id", "item_id", "template_share", "plain_share", "n_slots", "n_changed", "consistent").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per input row: id, contaminated, n_items, item_ids (sorted), most_share (of an item's windows).

    Rows that repeat an id are one document; null ids and texts are clean. Empty in, empty out."""
    found = leaks(docs, benchmark, id_col, **how).groupBy("id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.greatest("template_share", "plain_share")).alias("most_share"))
    out = docs.select(F.col(id_col).alias("id")).join(found, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), "item_ids", "most_share")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, whose document holds no benchmark item.

    Null ids and null, empty or short texts hold none and stay. All rows of an id go if one of its texts holds an item;
    a share equal to the one asked for counts as held. Texts of any length are read whole. Empty in, empty out."""
    return without(docs, id_col, scratch(leaks(docs, benchmark, id_col, **how).select("id").distinct()))
