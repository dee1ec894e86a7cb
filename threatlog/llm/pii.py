"""Personal data: four base kinds by pattern, and bootstrapped contextual extraction; DataFrame functions only.

The base spans seed the method: the instance of a seed is its whole span.  Other instances are tokens that
look like an identifier (they hold a digit or @), and runs of tokens of digits and punctuation, joined by
single blanks.  Each is in the contexts before it: its two words, and its one word, to the left, with each
number in them as 0.  A context is a pattern
for a kind; its confidence is the mean score of the distinct instances it holds, a seed of the kind
counting as one.  An instance's score is that of being right in at least one of its patterns.  Both are
scored in turn over the pattern-instance graph, and tokens that confident patterns agree on are new spans.

A text is cut by a pattern to learn where its matches are: Spark gives matches without places, but the
lengths of what is between and of the matches add up to them.  All patterns are linear: runs start where
they begin, and no group is repeated, which the JVM would do by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many distinct seeds of its kind; spans come from patterns and instances of this score.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Characters before a token that are looked at for its context.
CONTEXT = 64
#: A run of more digits is no single identifier, only its tokens are; a token of so many digits can be one in any run.
LONGEST, ALONE = 19, 8
#: Matches that are placed in one go; see :func:`_places`.
CHUNK = 256

#: A private-use character that stands for a separator inside a run; found in a text, it is taken for another one.
_MARK, _OTHER = "\ue000", "\ue001"
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_EMAIL = rf"(?:\G|(?<![{_MARK}{_LOCAL}]))[{_MARK}{_LOCAL}]++@[{_LABEL}]++{_MARK}[{_MARK}{_LABEL}]++"
_IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_CARD = rf"[0-9][0-9{_MARK}]*[0-9]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: A single blank within a run, which the mark then stands for.
_JOINT = r"(?<=[0-9]|\([0-9]{1,6}\)|[0-9] [/-]) (?=[0-9]|\([0-9]{1,6}\)|[/-] [0-9])"
#: A run without letters, or one token; its first token holds a digit or @.
_UNIT = (
    rf"(?<![^\s{_MARK}])(?=[^\s{_MARK}0-9@]*+[0-9@])"
    rf"(?:[^\s\p{{L}}@]*[^\s\p{{L}}@{_MARK}](?![^\s{_MARK}])|[^\s{_MARK}]++)"
)

_PLACES = "array<struct<s: int, e: int, m: string>>"


def _places(df: DataFrame, text: str, pattern: str, when: Column, name: str) -> DataFrame:
    """Adds ``name``: start, end (code points, end exclusive) and text of each match of ``pattern``.

    Matches are placed within chunks, then the chunks: the cost of adding to a growing array stays small.
    """
    none = F.lit(None).cast("array<string>")
    df = df.withColumn("_m", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("_m") > 0
    df = df.withColumn("_g", F.when(some, F.split(text, pattern, -1)))
    zipped = F.arrays_zip(F.slice("_g", F.lit(1), F.size("_m")).alias("g"), F.col("_m").alias("m"))
    df = df.withColumn("_z", F.when(some, zipped))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_z") - 1) / CHUNK).cast("int")),
        lambda k: F.slice("_z", k * CHUNK + 1, F.lit(CHUNK)),
    )
    df = df.withColumn("_c", F.when(some, chunks)).drop("_z")
    width = lambda x: F.length(x["g"]) + F.length(x["m"])
    sums = F.transform("_c", lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + width(x)))
    df = df.withColumn("_w", sums)
    starts = F.aggregate(
        "_w", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
    )["all"]
    df = df.withColumn("_s", starts)

    def within(chunk, start):
        empty = F.struct(start.alias("at"), F.array().cast(_PLACES).alias("all"))

        def step(acc, x):
            s = acc["at"] + F.length(x["g"])
            place = F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"))
            return F.struct((s + F.length(x["m"])).alias("at"), F.concat(acc["all"], F.array(place)).alias("all"))

        return F.aggregate(chunk, empty, step)["all"]

    placed = F.coalesce(F.flatten(F.zip_with("_c", "_s", within)), F.array().cast(_PLACES))
    return df.withColumn(name, placed).drop("_m", "_c", "_w", "_s")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits pass: from the right, every second is doubled, a result over 9 less 9."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - F.pmod(i, F.lit(2))),
    )
    total = F.aggregate(each, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0))
    return F.pmod(total, F.lit(10)) == 0


def _marked(text: Column, separator: str, side: str) -> Column:
    """The text with each single separator between characters of ``side`` replaced by the mark."""
    plain = F.translate(text, _MARK, _OTHER)
    return F.regexp_replace(plain, rf"(?<=[{side}])[{separator}](?=[{side}])", _MARK)


def base_spans(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with an array ``email``, ``ip``, ``card``, ``phone`` of (s, e, m) each; a null text has none."""
    df = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    has = F.col("_text")
    df = df.withColumn("_digit", has.rlike("[0-9@]"))
    df = df.withColumn("_at", F.when(F.contains(has, F.lit("@")), _marked(has, ".", _LABEL)))
    df = _places(df, "_at", _EMAIL, F.col("_at").isNotNull(), "email").drop("_g", "_at")
    df = _places(df, "_text", _IP, F.col("_digit") & has.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "ip").drop("_g")
    # No run of so few digits can be a card.
    df = df.withColumn("_run", F.when(F.col("_digit") & has.rlike("[0-9](?:[ -]?[0-9]){15}"), _marked(has, " -", "0-9")))
    df = _places(df, "_run", _CARD, F.col("_run").isNotNull(), "card").drop("_g", "_run")
    df = _places(df, "_text", _PHONE, F.col("_digit") & has.rlike(r"\+[0-9]"), "phone").drop("_g")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    count = lambda m: F.length(digits(m))
    df = df.withColumns(
        {
            "email": F.transform("email", lambda x: x.withField("m", F.translate(x["m"], _MARK, "."))),
            "ip": F.filter("ip", lambda x: x["m"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")),
            "card": F.filter("card", lambda x: F.when(count(x["m"]).between(16, 19), _luhn(digits(x["m"]))).otherwise(False)),
            "phone": F.filter("phone", lambda x: count(x["m"]).between(8, 15)),
        }
    )
    return df


def _occurrences(df: DataFrame) -> DataFrame:
    """Adds ``tokens``: place, text and left context of each run or token with a digit or @; needs :func:`base_spans`."""
    joined = F.regexp_replace(F.translate("_text", _MARK, _OTHER), _JOINT, _MARK)
    df = df.withColumn("_unit", F.when(F.col("_digit"), joined))
    df = _places(df, "_unit", _UNIT, F.col("_digit"), "_t")
    # The text before a token: what is between, the token before, and once more, as two words need no more.
    plain = lambda x: F.translate(x, _MARK, " ")
    gap = F.transform(F.slice("_g", F.lit(1), F.size("_t")), lambda g: plain(F.right(g, F.lit(CONTEXT))))
    word = F.transform("_t", lambda t: plain(F.right(t["m"], F.lit(CONTEXT))))
    none = F.lit("")
    zipped = F.arrays_zip(
        F.col("_t").alias("t"), F.concat(F.array(none, none), word).alias("m2"), F.concat(F.array(none), gap).alias("g1"),
        F.concat(F.array(none), word).alias("m1"), gap.alias("g"),
    )
    joined = F.transform(
        F.filter(zipped, lambda x: x["t"].isNotNull()),
        lambda x: F.struct(
            x["t"]["s"].alias("s"), x["t"]["e"].alias("e"), plain(x["t"]["m"]).alias("m"),
            F.right(F.concat(x["m2"], x["g1"], x["m1"], x["g"]), F.lit(CONTEXT)).alias("left"),
        ),
    )
    return df.withColumn("tokens", F.when(F.size("_t") > 0, joined)).drop("_t", "_g", "_unit")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _instance(text: Column, kind: Column) -> Column:
    """What makes two spans one identifier: for cards and phones their digits, for others without letters all but blanks, brackets, + and -."""
    plain = F.when(text.rlike(r"[\p{L}@]"), text).otherwise(F.regexp_replace(text, "[ ()+-]", ""))
    return F.when(F.coalesce(kind >= KINDS.index("card"), F.lit(False)), _digits(text)).otherwise(plain)


def _bare(df: DataFrame) -> DataFrame:
    """``s``, ``e`` and ``m`` without punctuation at the ends; brackets around the first or last digits of several stay."""
    head, tail = r"[(\[{<\"']", r"[)\]}>\"'.,;:!?]"
    size = F.length("m")
    lead = size - F.length(F.regexp_replace("m", rf"^{head}+", "")) - F.col("m").rlike(rf"^{head}*\([0-9]+\)[ -]?[0-9(]").cast("int")
    rest = size - F.length(F.regexp_replace("m", rf"(?<!{tail}){tail}++$", "")) - F.col("m").rlike(rf"[0-9 -]\([0-9]+\){tail}*$").cast("int")
    df = df.withColumns({"_lead": lead, "_rest": rest}).where(F.col("_lead") + F.col("_rest") < size)
    cut = F.substring(F.col("m"), F.col("_lead") + 1, size - F.col("_lead") - F.col("_rest"))
    return df.withColumns({"s": F.col("s") + F.col("_lead"), "e": F.col("e") - F.col("_rest"), "m": cut}).drop("_lead", "_rest")


def _readings(df: DataFrame) -> DataFrame:
    """Rows ``s``, ``m``, ``left`` of runs made the identifiers they can be: the run, and tokens of it that are long enough."""
    df = _places(df, "m", r"(?<!\S)\S++", F.contains("m", F.lit(" ")), "_words").drop("_g")
    words, none = F.transform("_words", lambda x: x["m"]), F.lit(None).cast("string")
    df = df.withColumns({"_p": F.concat(F.array(none), words), "_q": F.concat(F.array(none, none), words)})
    each = F.filter(F.arrays_zip(F.col("_words").alias("w"), F.col("_p").alias("p"), F.col("_q").alias("q")), lambda x: x["w"].isNotNull())
    read = lambda at, m, left: F.struct(at.alias("s"), m.alias("m"), F.right(left, F.lit(CONTEXT)).alias("left"))
    blank = F.lit(" ")
    each = F.transform(
        each,
        lambda x: read(
            F.col("s") + x["w"]["s"], x["w"]["m"],
            F.when(x["p"].isNull(), F.col("left")).when(x["q"].isNull(), F.concat("left", x["p"], blank))
            .otherwise(F.concat(blank, x["q"], blank, x["p"], blank)),
        ),
    )
    df = df.withColumns({"_each": each, "_n": F.length(_digits(F.col("m")))})
    run = F.array(read(F.col("s"), F.col("m"), F.col("left")))
    long = F.filter("_each", lambda x: F.length(_digits(x["m"])) >= ALONE)
    readings = F.when(F.size("_words") == 0, run).when(F.col("_n") <= LONGEST, F.concat(run, long)).otherwise(F.col("_each"))
    return df.select("id", "text_hash", F.explode(readings).alias("r")).select("id", "text_hash", "r.*").where(F.col("m").rlike("[0-9@]"))


def _instances(table: DataFrame) -> DataFrame:
    """``id``, ``text_hash``, ``seed``, ``instance``, ``s``, ``e``, ``patterns``: seeds, and what else can be an identifier (``seed`` is null)."""
    units = table.where("size(tokens) > 0").select("id", "text_hash", "seeds", F.explode("tokens").alias("t"))
    near = F.filter("seeds", lambda b: (b["s"] < F.col("t.e")) & (b["e"] > F.col("t.s")))
    near = F.transform(near, lambda b: F.struct(b["s"].alias("s"), (-b["e"]).alias("back"), b["kind"].alias("kind"), b["m"].alias("m")))
    units = units.select("id", "text_hash", F.sort_array(near).alias("near"), "t.*")
    touched, free = units.where("size(near) > 0"), units.where("size(near) = 0").select("id", "text_hash", "s", "m", "left")
    # A span that overlaps the one before it is no identifier by itself, and one that began earlier has its instance there.
    ends = F.concat(F.array(F.lit(0)), F.transform("near", lambda x: -x["back"]))
    first = F.filter(
        F.arrays_zip(F.col("near").alias("x"), ends.alias("before")),
        lambda y: (y["x"]["s"] >= F.col("s")) & (y["x"]["s"] >= y["before"]),
    )
    first = F.transform(first, lambda y: y["x"])
    unit = F.when(F.contains("m", F.lit(" ")), F.col("m")).otherwise("")
    seeds = touched.select("id", "text_hash", F.explode(first).alias("x"), F.col("s").alias("from"), unit.alias("unit"), "left")
    prefix = F.regexp_replace(F.substring(F.col("unit"), F.lit(1), F.col("x.s") - F.col("from")), r"\S++$", "")
    seeds = seeds.select(
        "id", "text_hash", F.col("x.kind").alias("seed"), _instance(F.col("x.m"), F.col("x.kind")).alias("instance"),
        F.col("x.s").alias("s"), (-F.col("x.back")).alias("e"), F.right(F.concat("left", prefix), F.lit(CONTEXT)).alias("left"),
    )
    # Of a run that holds spans, the whole tokens between them.
    gaps = F.arrays_zip(
        F.concat(F.array("s"), F.transform("near", lambda x: -x["back"])).alias("s"),
        F.concat(F.transform("near", lambda x: x["s"]), F.array("e")).alias("e"),
    )
    gaps = F.filter(gaps, lambda x: x["e"] > x["s"])
    rest = touched.where(F.contains("m", F.lit(" "))).select("*", F.explode(gaps).alias("g"))
    piece = F.substring(F.col("m"), F.col("g.s") - F.col("s") + 1, F.col("g.e") - F.col("g.s"))
    piece = F.when(F.col("g.e") < F.col("e"), F.regexp_replace(piece, r"(?<!\S)\S++$", "")).otherwise(piece)
    rest = rest.withColumn("piece", piece)
    cut = F.regexp_replace("piece", r"^\S+", "")
    cut = F.regexp_replace(F.when(F.col("g.s") > F.col("s"), cut).otherwise(F.col("piece")), "^ +", "")
    rest = rest.withColumn("cut", cut)
    at = F.col("g.s") + F.length("piece") - F.length("cut")
    within = F.exists("near", lambda x: (x["s"] < at + F.length("cut")) & (-x["back"] > at))
    rest = rest.where(F.col("cut").rlike("[0-9@]") & ~within).select(
        "id", "text_hash", at.alias("s"), F.rtrim("cut").alias("m"),
        F.right(F.concat("left", F.substring(F.col("m"), F.lit(1), at - F.col("s"))), F.lit(CONTEXT)).alias("left"),
    )
    other = _readings(free.union(rest))
    other = _bare(other.withColumn("e", F.col("s") + F.length("m")))
    other = other.select(
        "id", "text_hash", F.lit(None).cast("int").alias("seed"), _instance(F.col("m"), F.lit(None).cast("int")).alias("instance"), "s", "e", "left"
    )
    found = seeds.union(other).where("instance <> ''").withColumn("left", F.regexp_replace(F.lower("left"), "[0-9]+", "0"))
    found = found.withColumns(
        {"left2": F.regexp_extract("left", r"(\S+)\s+\S+\s*$", 1), "left1": F.regexp_extract("left", r"(\S+)\s*$", 1)}
    )
    patterns = F.array_compact(
        F.array(
            F.when(F.col("left2") != "", F.concat(F.lit("2 "), "left2", F.lit(" "), "left1")),
            F.when(F.col("left1") != "", F.concat(F.lit("1 "), "left1")),
        )
    )
    return found.select("id", "text_hash", "seed", "instance", "s", "e", patterns.alias("patterns"))


def _span_of(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _seed_of(kind: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))


def personal_data(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``id``, ``text_hash``, ``base`` and ``added``: spans (kind number, s, e), by kind, then start; one row per document and text.

    The text is scanned once; what follows works on a table of spans and tokens.  Null texts and texts
    without a span have empty arrays.  Equal rows give a row each; a null id stays null.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _occurrences(base_spans(rows))
    spans = F.concat(*[F.transform(kind, _span_of(k)) for k, kind in enumerate(KINDS)])
    seeds = F.concat(*[F.transform(kind, _seed_of(k)) for k, kind in enumerate(KINDS)])
    table = found.select("id", F.xxhash64("_text").alias("text_hash"), spans.alias("base"), seeds.alias("seeds"), "tokens")
    table = staged(table)
    added = _discovered(table)
    held = table.select("id", "text_hash", "base")
    if added is None:
        return held.withColumn("added", F.array().cast("array<struct<kind: int, s: int, e: int>>"))
    added = added.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("kind", "s", "e"))).alias("added"))
    same = held.id.eqNullSafe(added.id) & (held.text_hash == added.text_hash)
    none = F.array().cast("array<struct<kind: int, s: int, e: int>>")
    return held.join(added, same, "left").select(held.id, held.text_hash, "base", F.coalesce("added", none).alias("added"))


def _discovered(table: DataFrame) -> DataFrame | None:
    """``id``, ``text_hash``, ``kind``, ``s``, ``e`` of the spans that confident patterns add; None if no pattern has support."""
    places = staged(_instances(table).withColumn("pattern", F.explode("patterns")).drop("patterns"))
    edges = places.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    enough = edges.where("seed is not null").groupBy("pattern", "seed").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    enough = staged(enough.select("pattern").distinct())
    if enough.isEmpty():
        return None
    edges = staged(edges.join(enough, "pattern"))
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    seeds = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    seeds = seeds.where(F.col("seeds") >= SUPPORT)
    size = staged(size.join(seeds, "pattern"))
    for _ in range(ROUNDS):
        held = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("right"))
        confidence = held.join(size, ["pattern", "kind"]).select("pattern", "kind", (F.col("right") / (F.col("n") + 1)).alias("confidence"))
        confidence = staged(confidence.where(F.col("confidence") >= CONFIDENCE))
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        new = edges.where("seed is null").join(confidence, "pattern").groupBy("instance", "kind").agg((1 - wrong).alias("score"))
        seen = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
        scores = staged(seen.union(new).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    # An identifier has at least four digits or an @; of two kinds the better one.
    good = scores.where(F.col("score") >= CONFIDENCE).groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"), "kind"))["kind"].alias("kind"))
    looks = (F.length(_digits(F.col("instance"))) >= 4) | F.contains("instance", F.lit("@"))
    places = places.where("seed is null").where(looks)
    out = places.join(confidence.select("pattern", "kind"), "pattern").join(good, ["instance", "kind"])
    return out.select("id", "text_hash", "kind", "s", "e").distinct()


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def span_digests(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document and text: id, counts of the base kinds, ``base_sha256``, ``spans`` (base and added)."""
    found = personal_data(docs, id_col, text_col)
    every = F.sort_array(F.concat("base", "added"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        F.col("id").alias(id_col), *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(every).alias("spans"),
    )


def redacted(docs: DataFrame, id_col="doc_id", text_col="text", length_col: str | None = None) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; other texts are unchanged.

    Of overlapping spans the one that starts first (then the longer) is named, and the rest of the other
    goes too.  ``length_col``, if ``docs`` has it, becomes the length of a changed text.  Repeated rows are
    changed alike.
    """
    found = personal_data(docs, id_col, text_col)
    spans = F.transform(F.concat("base", "added"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["kind"].alias("kind")))
    hits = found.where("size(base) + size(added) > 0").select("id", "text_hash", F.sort_array(spans).alias("_spans"))
    hits = hits.dropDuplicates(["id", "text_hash"])
    # Columns go by place, so that no name of ``docs`` is in the way.
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(x) for c, x in place.items()])
    own, key = F.col(place[text_col]), F.col(place[id_col])
    text = F.coalesce(own, F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        piece = F.when(
            x["s"] >= acc["at"],
            F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["kind"]))),
        ).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], -x["back"]).alias("at"), piece.alias("parts"))

    joined = rows.join(hits, key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("text_hash")), "left")
    joined = joined.withColumn("cut", F.when(F.col("_spans").isNotNull(), F.aggregate("_spans", start, step)))
    rest = F.substring(text, F.col("cut.at") + 1, F.length(text))
    new = F.when(F.col("cut").isNotNull(), F.concat(F.array_join("cut.parts", ""), rest)).otherwise(own)
    joined = joined.withColumn("new", new)
    out = []
    for c, x in place.items():
        if c == text_col:
            out.append(F.col("new").alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("cut").isNotNull(), F.length("new").cast(kind)).otherwise(F.col(x)).alias(c))
        else:
            out.append(F.col(x).alias(c))
    return joined.select(*out)
