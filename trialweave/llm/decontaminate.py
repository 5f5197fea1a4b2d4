"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts are put into a canonical form: lower case, words without punctuation, and typed placeholders for
numbers (#n), names (#p) and units (#u) whose values are kept beside them. Windows of eight canonical
words are hashed and joined to those of the benchmark. Where a window has slots, the values of benchmark
and document are paired: a document that replaces each value by always the same other value asks the
same question with other parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import cut_lineage

WINDOW = 8
#: Benchmark texts of fewer canonical words name no question and are left out.
LEAST = 5
#: Windows with fewer words beside their slots name no question: counting is no leak of other counting.
PLAIN = 2
#: Share of a benchmark text's windows that a document must hold.
COVERAGE = 0.5
# fixed values: units that follow a number
UNITS = (
    "kg mg g km cm mm m ml l s min h kb mb gb hz khz mhz w kw v a k percent dollars euros cents years year months "
    "month weeks week days day hours hour minutes minute seconds second meters metres miles feet inches pounds tons "
    "meter metre mile foot inch pound ton tonnes tonne dollar euro cent kilograms kilogram grams gram milligrams "
    "milligram kilometers kilometres kilometer kilometre centimeters centimetres centimeter centimetre millimeters "
    "millimetres millimeter millimetre liters litres liter litre milliliters millilitres milliliter millilitre "
    "ounces ounce yards yard gallons gallon acres acre hectares hectare degrees degree watts watt volts volt"
).split()
_UNIT = r"([0-9])\x20?(" + "|".join(UNITS) + r")\b"
_NAME = r"(\p{Lu}(?<![\p{L}\p{N}_:]\p{Lu})\p{Ll}+)"
# a capitalised word inside a sentence
_INSIDE = r"#q(?<=[\p{Ll},;][\x20\x09-\x0D]#q):"
#: Kinds of templates: names inside sentences only; every capitalised word, neighbouring ones as one name.
KINDS = (0, 1)
_BREAK = r"[^\p{L}\p{N}#:_]+"


def _starts(word: Column, *marks: str) -> Column:
    found = [F.startswith(word, F.lit(m)) for m in marks]
    return found[0] if len(found) == 1 else found[0] | found[1]


def _words(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, words): lower-case words; values of slots as #n:..., #u:..., #p:... and, where a sentence starts, #q:..."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), F.translate(text, "#:_", "   ").alias("t"))
    n = F.regexp_replace("t", _UNIT, "$1 #u:$2 ")
    for _ in range(2):  # neighbouring matches share a digit
        n = F.regexp_replace(n, r"([0-9])[.,]([0-9])", "$1_$2")
    n = F.regexp_replace(n, r"([0-9][0-9_]*)", " #n:$1 ")
    t = F.when(F.rlike("t", F.lit("[0-9]")), n).otherwise(F.col("t"))
    t = F.regexp_replace(F.regexp_replace(t, _NAME, "#q:$1"), _INSIDE, "#p:")
    return rows.select("id", "text_key", F.array_remove(F.split(F.lower(t), _BREAK, -1), "").alias("words"))


def templates(table: DataFrame, id_col: str, text_col: str, kind: int = 0) -> DataFrame:
    """(id, marked, canon): arrays of equal length of a text's words with and without slot values."""
    rows = _words(table, id_col, text_col)
    if kind == 0:
        marked = F.transform("words", lambda w: F.when(_starts(w, "#q:"), F.substr(w, F.lit(4))).otherwise(w))
    else:  # a run of names is joined where the mark at the end of one meets that at the start of the next
        name = lambda w: F.concat(F.lit("#p:"), F.substr(w, F.lit(4)), F.lit(";"))
        text = F.array_join(F.transform("words", lambda w: F.when(_starts(w, "#p:", "#q:"), name(w)).otherwise(w)), " ")
        text = F.replace(F.replace(text, F.lit("; #p:"), F.lit("_")), F.lit(";"), F.lit(""))
        marked = F.array_remove(F.split(text, " ", -1), "")
    rows = rows.select("id", marked.alias("marked"))
    return rows.select("id", "marked", F.transform("marked", lambda w: F.when(_starts(w, "#"), F.left(w, F.lit(2))).otherwise(w)).alias("canon"))


def _hashes(kind: int) -> Column:
    """Hashes of the canonical words of ``words``, without the slots' values."""
    words = F.col("words")
    if kind == 0:
        plain = F.transform(
            words,
            lambda w: F.xxhash64(F.when(_starts(w, "#q:"), F.substr(w, F.lit(4))).when(_starts(w, "#"), F.left(w, F.lit(2))).otherwise(w)),
        )
    else:
        names = ("#p:", "#q:")
        first = F.filter(words, lambda w, i: ~_starts(w, *names) | (i == 0) | ~_starts(F.get(words, i - 1), *names))
        plain = F.transform(
            first,
            lambda w: F.xxhash64(F.when(_starts(w, *names), F.lit("#p")).when(_starts(w, "#"), F.left(w, F.lit(2))).otherwise(w)),
        )
    return plain


def _keyed(rows: DataFrame, width: int, kinds: dict[str, int]) -> DataFrame:
    """``rows`` with a column ``keys_<kind>_<width>``, the hashes of all windows, for each column of word hashes.

    Hashes of two words come from their neighbours', those of four from the twos, those of five to eight
    from two overlapping fours, so a window costs three steps at any width.
    """

    def join(c: str, by: int, mark: int | None = None) -> Column:
        later = F.slice(c, by + 1, F.size(c))
        return F.zip_with(c, later, lambda a, b: F.xxhash64(a, b) if mark is None else F.xxhash64(F.lit(mark), a, b))

    for c, kind in kinds.items():
        if f"{c}_4" not in rows.columns:
            rows = rows.withColumn(f"{c}_2", join(c, 1))
            rows = rows.withColumn(f"{c}_4", join(f"{c}_2", 2))
        whole = F.slice(join(f"{c}_4", width - 4, 16 * kind + width), 1, F.greatest(F.size(c) - width + 1, F.lit(0)))
        rows = rows.withColumn(f"keys_{kind}_{width}", whole)
    return rows


def _windows(table: DataFrame, width: int, kind: int) -> DataFrame:
    """(id, pos, width, key, slots, plain): every window of a row's words; slots only where it has some."""
    rows = table.withColumn("h", F.transform("canon", lambda w: F.xxhash64(w)))
    rows = _keyed(rows, width, {"h": kind})
    window = F.transform(  # with its slots, so that no row of a window holds the whole text
        f"keys_{kind}_{width}",
        lambda key, i: F.struct(
            (i + 1).alias("pos"), key.alias("key"), F.filter(F.slice("marked", i + 1, width), lambda w: _starts(w, "#")).alias("v")
        ),
    )
    rows = rows.select("id", window.alias("w")).select("id", F.inline("w"))
    slots, plain = F.when(F.size("v") > 0, F.col("v")), width - F.size("v")
    return rows.select("id", "pos", F.lit(width).alias("width"), "key", slots.alias("slots"), plain.alias("plain"))


def _suspects(docs: DataFrame, id_col: str, text_col: str, known: DataFrame, total: DataFrame, widths: list[int], coverage: float) -> DataFrame:
    """The rows whose texts hold enough windows of a benchmark text, whatever their slots hold.

    One pass over the texts: all window hashes meet the benchmark's, and what remains is counted by text.
    """
    rows = _words(docs, id_col, text_col).select("text_key", *[_hashes(k).alias(f"h{k}") for k in KINDS])
    for width in widths:
        rows = _keyed(rows, width, {f"h{k}": k for k in KINDS})
    keys = F.concat(*[F.col(f"keys_{k}_{w}") for k in KINDS for w in widths])
    held = rows.select("text_key", F.explode(keys).alias("key")).join(known.select("key").distinct(), "key").distinct()
    at = known.select("key", "kind", F.col("id").alias("item_id"), "pos").distinct()
    held = held.join(at, "key").groupBy("text_key", "kind", "item_id").agg(F.count_distinct("pos").alias("matched"))
    held = held.join(total, (held.item_id == total.id) & (held.kind == total.k)).where(F.col("matched") >= coverage * F.col("windows"))
    texts = cut_lineage(held.select(F.col("text_key").alias("__text")).distinct(), "suspects")
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(texts, own == F.col("__text"), "left_semi").select(id_col, text_col)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """(doc_id, item_id, windows, matched, slots, changed): pairs of a document and a benchmark text it holds.

    ``matched`` of the text's ``windows`` stand in the document, counted over the places (differences of
    position) at which every slot value of the benchmark stands for one value only; ``slots`` distinct
    slot values were compared there and ``changed`` of them differ. A pair is given where matched reaches
    the coverage. Windows with fewer than two words beside their slots do not count. Benchmark texts of 5
    to 7 words are one window; shorter, empty or missing ones are left out. Texts are compared in two kinds of templates, with names inside sentences as slots and with every
    capitalised word (neighbouring ones, of any number, as one); a pair that both give has the figures of the first. Missing and
    empty documents hold nothing; rows without id are searched and named by NULL.
    Repeated rows count once. Benchmark rows of one id are one text each and count together.
    """
    known = None
    for kind in KINDS:
        items = cut_lineage(templates(benchmark, item_col, item_text, kind).where(F.size("canon") >= LEAST), "templates")
        for width in range(LEAST, WINDOW + 1):
            own = F.size("canon") == width if width < WINDOW else F.size("canon") >= width
            part = _windows(items.where(own), width, kind).withColumn("kind", F.lit(kind)).where(F.col("plain") >= PLAIN)
            known = part if known is None else known.unionByName(part)
    known = cut_lineage(known.drop("plain").distinct(), "windows")
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # 5 to 8
    total = known.groupBy("id", F.col("kind").alias("k")).agg(F.count_distinct("pos").alias("windows"))
    keys = known.select("key", "kind", F.col("id").alias("item_id"), F.col("pos").alias("at"), F.col("slots").alias("theirs"))

    suspects = _suspects(docs, id_col, text_col, known, total, widths or [WINDOW], coverage)
    found = None
    for kind in KINDS:
        own = cut_lineage(templates(suspects, id_col, text_col, kind), "templates")
        for width in widths or [WINDOW]:
            part = _windows(own, width, kind).drop("plain").join(keys, "key")
            found = part if found is None else found.unionByName(part)
    found = found.select(
        F.col("id").alias("doc_id"), "item_id", "kind", (F.col("pos") - F.col("at")).alias("place"), "at", "slots", "theirs"
    ).distinct()
    found = cut_lineage(found, "matches")

    pair = F.explode(F.arrays_zip(F.col("theirs").alias("was"), F.col("slots").alias("now")))
    where = ["doc_id", "item_id", "kind", "place"]
    slots = found.where("slots is not null").select(*where, pair.alias("p"))
    slots = slots.select(*where, F.col("p.was").alias("was"), F.col("p.now").alias("now"))
    values = slots.groupBy(*where, "was").agg(F.min("now").alias("low"), F.max("now").alias("high"))
    values = values.groupBy(*where).agg(
        F.count("*").alias("slots"),
        F.sum((F.col("low") != F.col("was")).cast("long")).alias("changed"),
        F.max(F.col("low") != F.col("high")).alias("mixed"),
    )
    values = values.toDF("d", "i", "k", "p", "slots", "changed", "mixed")
    same = (F.col("item_id") == F.col("i")) & (F.col("kind") == F.col("k")) & (F.col("place") == F.col("p"))
    placed = found.select(*where, "at").join(values, F.col("doc_id").eqNullSafe(F.col("d")) & same, "left")
    placed = placed.where("mixed is null or not mixed").select(
        "doc_id",
        "item_id",
        "kind",
        "at",
        F.coalesce("slots", F.lit(0)).alias("slots"),
        F.coalesce("changed", F.lit(0)).alias("changed"),
    )
    held = placed.groupBy("doc_id", "item_id", "kind").agg(
        F.count_distinct("at").alias("matched"), F.max("slots").alias("slots"), F.max("changed").alias("changed")
    )
    held = held.join(total, (held.item_id == total.id) & (held.kind == total.k))
    held = held.where(F.col("matched") >= coverage * F.col("windows"))
    held = held.groupBy("doc_id", "item_id").agg(F.min(F.struct("kind", "windows", "matched", "slots", "changed")).alias("h"))
    return held.select("doc_id", "item_id", "h.windows", "h.matched", "h.slots", "h.changed")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark text, all columns as they are; rows without id stay."""
    named = cut_lineage(leaks(docs, benchmark, id_col, text_col).select("doc_id").distinct(), "leaks")
    return docs.join(named.withColumnRenamed("doc_id", "__leak"), docs[id_col].cast("long") == F.col("__leak"), "left_anti")
