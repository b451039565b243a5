"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines (trimmed of white space) of ``least_chars`` characters or more are compared; with 1, all that are not
blank. Equal lines of any length are one class, named by hash; classes are made first, combined before the
shuffle, so a line that fills a third of the corpus is one row from then on. Classes may differ by one edit for
every ten characters of the longer line, by two at most: shorter lines are so close by chance alone.

Lengths are cut into bands (``band``). For edit threshold 2, three segments of a line that do not touch, their size set by the
band, are its index rows: its first characters, those behind, and its last ones counted from the end. Two edits leave one of three
segments whole. The first and the last are then in place; the middle one is moved by a place at most, and only if
there is an edit on either side of it, so of two lines one finds the other's middle in place or one further on, which is its
probe. For threshold 1 (9 to 19 characters) a first and a last segment do. A line at the start of its band also enters the band below.

Rows of index and probe are two numbers, hash of (band, segment, substring) and line. Counting says which signatures several
lines share; rows of others, nearly all, go at once. Lines of those that stay get letter counts, made once a line, and meet by
signature, length and counts, which bound the edit distance from below. Signatures that many
lines share (numbered template lines) are dealt to blocks of ``block_rows`` lines, and probes go to each block, so no task holds
one of these whole. Pairs that remain are decided by a bit-parallel automaton of the diagonal band: five bits
for each number of errors, moved along the line.

A line goes if an equal line, or one within the allowed edits, stands earlier (by doc_id, then line number).

Defined results for odd input: a null text has no lines; rows without doc_id come after all others, as
one document; rows that share a doc_id are read as the same document, so lines at one line number do
not remove each other, but each row loses lines of its own text only; blank lines stay; an empty table gives no rows; other columns are ignored by
``line_links`` and kept by ``without_repeated_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import discard, made, partitions, semi_join, table

BLANKS = " \t\n\r\x0b\x0c"
#: Characters counted before a pair is verified, fifteen to a number; any frequent ones serve.
LETTERS = ("entiaorshdlucgm", " fpwybvkxjqz,.E", "TAIOSRN01234567", "89-|:;!?()'LDCM")
LAST = 2**63 - 1
#: Characters of a line for each edit, and from how many on two are allowed.
TENTH, LONG = 10, 20


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that have no doc_id or share one."""
    return F.xxhash64(text)


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc, text_key, line_no, line, a, b): trimmed lines that are compared, ``doc`` with rows without id last, a hash of the
    row's text, and two of the line."""
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))
    out = docs.select(doc.alias("doc"), text_key(docs["text"]).alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    out = out.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= least_chars)
    return out.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(2), "line")})


def letter_count(line: Column, letter: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))


def bag(line: Column, letters: str) -> Column:
    """Up to fifteen letter counts modulo 16 in one number."""
    out = F.lit(0).cast("long")
    for k, x in enumerate(letters):
        out = out.bitwiseOR(F.shiftleft(letter_count(line, x).cast("long").bitwiseAND(15), 4 * k))
    return out


EACH, ODD, BYTES = 0x0111111111111111, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101


def parities(bags: list[str]) -> Column:
    """The lowest bits of all letter counts in one number. One edit changes two counts by one at most, so two bits."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(bags):
        out = out.bitwiseOR(F.shiftleft(F.col(c).bitwiseAND(EACH), k))
    return out


def bag_distance(x: Column, y: Column) -> Column:
    """A lower bound of twice the edit distance: one edit changes two counts by one at most. Counts are taken in two halves, each
    with a byte to itself, all bytes of a number at once."""
    out = F.lit(0).cast("long")
    for shift in (0, 4):
        half = lambda v: F.shiftright(v, shift).bitwiseAND(ODD)  # noqa: B023, E731
        apart = (half(x) + 16 * BYTES - half(y)).bitwiseAND(ODD)
        far = F.shiftright(apart, 3).bitwiseAND(BYTES)  # differences of 8 and more go the other way round modulo 16
        out = out + apart.bitwiseXOR(far * 15) + far
    for step, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        out = out.bitwiseAND(mask) + F.shiftright(out, step).bitwiseAND(mask)
    return out


def band(length: Column) -> Column:
    """The least length of the band of lengths that holds ``length``."""
    return F.when(length < 64, length - length % 4).otherwise(length - length % 16)


#: Places that meet by signature: three segments for two edits, the first of which is also the place of a moved middle; two segments for one.
INDEX, PROBE = 0, 1


def _rows(line: Column, length: Column, start: Column, edits: int) -> list[Column]:
    """(signature, kind) of a line of ``length`` characters in the band from ``start``. Between the middle and the last segment
    is a place at least, so that a middle that is moved on by one is still whole."""
    size = F.floor((start - 1) / 3).cast("int") if edits == 2 else F.floor(start / 2).cast("int")
    row = lambda k, at, kind: F.struct(F.xxhash64(F.lit(k), start, F.substring(line, at, size)).alias("signature"), F.lit(kind).cast("byte").alias("kind"))
    ends = length - size + 1
    if edits == 1:
        return [row(3, F.lit(1), INDEX), row(4, ends, INDEX)]
    return [row(0, F.lit(1), INDEX), row(1, size + 1, INDEX), row(2, ends, INDEX), row(1, size + 2, PROBE)]


def signatures(line: Column, length: Column) -> Column:
    """Index and probe rows of a line, an array."""
    none = F.array().cast("array<struct<signature:bigint,kind:tinyint>>")
    out = []
    # Lines just under LONG characters are in both schemes: a longer one may be two edits away.
    for edits, fits in ((2, length >= LONG - 2), (1, length.between(TENTH - 1, LONG - 1))):
        own, below = band(length), band(length - edits)
        out += [F.when(fits, F.array(*_rows(line, length, own, edits))).otherwise(none)]
        out += [F.when(fits & (below < own), F.array(*_rows(line, length, below, edits))).otherwise(none)]
    return F.concat(*out)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are made once a row. The optimizer writes the definition of a plain column into every use of
    it, filters and lambda bodies included; what a generator returns it leaves alone."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_distance(pairs: DataFrame) -> DataFrame:
    """``pairs`` (x, y: texts that are not empty, ...) with ``distance``, their edit distance or -1 over 2: Wu and Manber's
    bit-parallel automaton on a diagonal band.

    Bit d + 2 of the e-th of three words says that the first j + d characters of ``y`` are within e edits of the first j
    of ``x``. ``moves`` has, for each j, five bits of equal characters and which places exist in ``y``. What the two share at either end is cut off first; the automaton runs over the rest.
    """
    m, n = F.col("m"), F.col("n")
    steps = F.array(*[F.lit(1 << k) for k in range(9, -1, -1)])

    def shared(place) -> Column:
        """Characters, up to 1023, that agree from an end on: ``place(length, from, size)`` is a stretch of a text."""
        longer = lambda k, size: (k + size <= F.least(m, n)) & (place("x", n, k, size) == place("y", m, k, size))
        return F.aggregate(steps, F.lit(0), lambda k, size: F.when(longer(k, size), k + size).otherwise(k))

    def moves(c: Column, j: Column) -> Column:
        equal = F.lit(0)
        for d in range(-2, 3):
            # No character has a place under 0: ``get`` gives null there as behind the end.
            equal = equal + F.when(F.get("ys", j + d) == c, 1 << (d + 2)).otherwise(0)
        exists = F.when(j + 3 <= m, 31).when(j + 2 == m, 15).when(j + 1 == m, 7).when(j == m, 3).otherwise(1)
        return F.struct(equal.alias("equal"), exists.alias("exists"))

    def step(w: Column, move: Column) -> Column:
        equal, exists = move["equal"], move["exists"]
        zero = w["zero"].bitwiseAND(equal)
        one = w["one"].bitwiseAND(equal).bitwiseOR(w["zero"]).bitwiseOR(F.shiftright(w["zero"], 1)).bitwiseOR(F.shiftleft(zero, 1)).bitwiseAND(exists)
        two = w["two"].bitwiseAND(equal).bitwiseOR(w["one"]).bitwiseOR(F.shiftright(w["one"], 1)).bitwiseOR(F.shiftleft(one, 1)).bitwiseAND(exists)
        return F.struct(zero.alias("zero"), one.alias("one"), two.alias("two"))

    start = F.struct(F.lit(4).alias("zero"), F.lit(12).alias("one"), F.lit(28).alias("two"))
    out = computed(pairs, m=F.char_length("y"), n=F.char_length("x"))
    out = computed(out, head=shared(lambda c, length, k, size: F.substr(F.col(c), k + 1, size)))
    rest = lambda c: F.substr(F.col(c), F.col("head") + 1)
    out = computed(out.drop("m", "n"), u=rest("x"), v=rest("y"))
    out = computed(out, m=F.char_length("v"), n=F.char_length("u"))
    out = computed(out, tail=shared(lambda c, length, k, size: F.substr(F.col({"x": "u", "y": "v"}[c]), length - k - size + 1, size)))
    rest = lambda c, length: F.substr(F.col(c), F.lit(1), length - F.col("tail"))
    out = computed(out, xs=F.split(rest("u", n), ""), ys=F.split(rest("v", m), ""), left=m - F.col("tail"), right=n - F.col("tail")).drop("m", "n").withColumnsRenamed({"left": "m", "right": "n"})
    out = computed(out, moves=F.transform("xs", moves))
    out = computed(out, end=F.aggregate("moves", start, step))
    at = F.call_function("shiftleft", F.lit(1), F.greatest(F.least(m - n, F.lit(2)), F.lit(-2)) + 2)
    reached = lambda word: F.col("end")[word].bitwiseAND(at) != 0
    far = F.abs(m - n) > 2
    distance = F.when(far, -1).when(F.least(m, n) == 0, F.greatest(m, n)).when(reached("zero"), 0).when(reached("one"), 1).when(reached("two"), 2).otherwise(-1)
    return out.withColumn("distance", distance).drop("head", "tail", "u", "v", "xs", "ys", "m", "n", "moves", "end")


def allowed_edits(length: Column) -> Column:
    """Edits that two lines may differ by, from the length of the longer."""
    return F.least(F.floor(length / TENTH), F.lit(2)).cast("int")


def line_classes(lines: DataFrame) -> DataFrame:
    """(a, b, first, copies, line) of each distinct line; copies are combined in the task that reads them."""
    return lines.groupBy("a", "b").agg(F.min(F.struct("doc", "line_no")).alias("first"), F.count("*").alias("copies"), F.first("line").alias("line"))


def candidates(classes: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, other) of classes that share a signature and whose lengths and letter counts allow a link, and the (id, b, line, n, bags)
    of all classes that share one."""
    lines = classes.select(F.col("a").alias("id"), F.char_length("line").alias("n"), "line")
    dealt = lines.select("id", F.inline(signatures(F.col("line"), F.col("n"))))
    dealt = table(dealt, "line-signatures")
    shared = dealt.groupBy("signature").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("kind").alias("kind"))
    shared = table(shared.filter((F.col("low") < F.col("high")) & (F.col("kind") == INDEX)).select("signature"), "line-shared")
    dealt = table(semi_join(dealt, shared, "signature"), "line-meetings")
    counts = [bag(F.col("line"), letters).alias(f"bag{k}") for k, letters in enumerate(LETTERS)]
    named = classes.select(F.col("a").alias("id"), "b", "line", F.char_length("line").alias("n"))
    texts = table(semi_join(named, dealt.select("id").distinct(), "id").select("*", *counts), "line-texts")

    # Lines of one hash (a) differ in b; either may link.
    bags = [c for c in texts.columns if c.startswith("bag")]
    numbers = texts.drop("line", "b").distinct().withColumn("odd", parities(bags))
    kept = dealt.filter(F.col("kind") == INDEX).select("signature", "id").distinct()
    asked = dealt.select("signature", F.col("id").alias("other"), "kind").groupBy("signature", "other").agg(F.min("kind").alias("kind"))
    heavy = kept.groupBy("signature").agg(F.count("*").alias("m")).filter(F.col("m") > block_rows)
    heavy = table(heavy.select("signature", F.ceil(F.col("m") / block_rows).cast("int").alias("blocks")), "line-heavy")
    on = ["signature"]
    if few := heavy.count():
        small = F.broadcast(heavy) if few <= 500_000 else heavy
        blocks = F.coalesce("blocks", F.lit(1))
        kept = kept.join(small, "signature", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).drop("blocks")
        asked = asked.join(small, "signature", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
        on = ["signature", "block"]
    kept = kept.join(numbers, "id")
    asked = asked.join(numbers.select(*[F.col(c).alias("other" if c == "id" else f"other_{c}") for c in numbers.columns]), "other")
    distance = sum((bag_distance(F.col(c), F.col(f"other_{c}")) for c in bags), F.lit(0))
    most = 2 * allowed_edits(F.greatest("n", "other_n"))
    near = (F.abs(F.col("n") - F.col("other_n")) <= 2) & (F.bit_count(F.col("odd").bitwiseXOR(F.col("other_odd"))) <= most) & (distance <= most)
    apart = F.when(F.col("kind") == INDEX, F.col("id") < F.col("other")).otherwise(F.col("id") != F.col("other"))
    pairs = kept.join(asked, on).filter(apart & near)
    return pairs.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct(), texts


def similar_lines(classes: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Pairs of ``classes`` (a, b, line) within the allowed edits: (a, b, other_a, other_b, distance), both ways round, hashes as names."""
    pairs, texts = candidates(classes, block_rows)
    pairs = table(pairs, "line-pairs")
    x, y = texts.select("id", "b", F.col("line").alias("x")), texts.select(F.col("id").alias("other"), F.col("b").alias("other_b"), F.col("line").alias("y"))
    # A partition for each of the table's: few rows, much work on each.
    near = with_distance(pairs.join(x, "id").join(y, "other").repartition(4 * partitions(classes.sparkSession)))
    allowed = allowed_edits(F.greatest(F.char_length("x"), F.char_length("y")))
    near = near.filter((F.col("distance") >= 0) & (F.col("distance") <= allowed))
    ends = lambda a, b, c, d: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("other_a"), F.col(d).alias("other_b"), "distance")
    return near.select(F.inline(F.array(ends("id", "b", "other", "other_b"), ends("other", "other_b", "id", "b"))))


def line_links(docs: DataFrame, least_chars: int = 20, block_rows: int = 4096) -> DataFrame:
    """A row per compared line of ``docs`` (doc_id, text): doc_id, line_no (from 0), ``first_doc_id`` and ``first_line_no`` of the
    first equal line (the class), ``copies`` of it, ``n_links`` (other classes within the allowed edits), ``near_doc_id`` and ``near_line_no`` of
    the earliest line of these, and ``kept``."""
    return _judged(lines_of(docs, least_chars).drop("text_key"), block_rows)


def _judged(lines: DataFrame, block_rows: int = 4096) -> DataFrame:
    """``line_links`` of ``lines``, with the ``text_key`` of each line's row where they have it."""
    names = table(lines.drop("line"), "line-names")
    first_mark = made()
    classes = table(line_classes(lines), "line-classes")
    links = similar_lines(classes, block_rows)
    classes = classes.drop("line")
    first = classes.select(F.col("a").alias("other_a"), F.col("b").alias("other_b"), F.col("first").alias("near"))
    links = links.join(first, ["other_a", "other_b"]).groupBy("a", "b").agg(F.count("*").alias("n_links"), F.min("near").alias("near"))
    # As a table: then the join with the names has a shuffle on either side, and Spark can split a line that is a third of them.
    last_mark = made()
    classes = table(classes.join(links, ["a", "b"], "left"), "line-judged")
    discard(first_mark, last_mark)
    out = names.join(classes, ["a", "b"])
    own = F.struct("doc", "line_no")
    original = (own == F.col("first")) & F.coalesce(F.col("near") > F.col("first"), F.lit(True))
    known = lambda doc: F.when(doc != LAST, doc)
    return out.select(
        *[c for c in lines.columns if c == "text_key"], known(F.col("doc")).alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), known(F.col("first.doc")).alias("first_doc_id"),
        F.col("first.line_no").cast("long").alias("first_line_no"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        known(F.col("near.doc")).alias("near_doc_id"), F.col("near.line_no").cast("long").alias("near_line_no"), original.alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, least_chars: int = 20, least_share: float = 0.0) -> DataFrame:
    """``docs``, all columns, with repeated lines taken out of ``text`` (``n_chars``, where present, is renewed).
    Documents that had words and have none left go, and those left with less than ``least_share`` of their characters."""
    gone = _judged(lines_of(docs, least_chars)).filter("not kept").groupBy(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"))
    gone = gone.agg(F.collect_set("line_no").alias("cut"))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("cut_id")) & (text_key(docs["text"]) == F.col("cut_key")), "left")
    parts, cut = F.split("text", "\n"), F.col("cut")
    places = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_parts") - F.lit(1).cast("long")), "cut")
    out = computed(out, _parts=F.when(cut.isNotNull(), parts))
    out = computed(out, _left=F.when(cut.isNotNull(), F.array_join(F.transform(places, lambda i: F.get("_parts", i.cast("int"))), "\n")))
    left = F.length(F.btrim("_left", F.lit(BLANKS)))
    out = out.filter(cut.isNull() | ((left > 0) & (left >= least_share * F.length("text"))))
    out = out.withColumn("text", F.when(cut.isNull(), F.col("text")).otherwise(F.col("_left"))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
