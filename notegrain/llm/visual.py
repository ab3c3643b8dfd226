"""One form for texts that look the same but differ in their characters.

Texts without a character that some rule touches are their own form and never leave the scan. From the others all
stretches of other characters than plain ASCII are taken (however long; one cheap regular expression); each distinct
stretch is exploded to positioned code points once, these are joined with the broadcast mappings (decomposition,
look-alikes, nothing for characters without a shape; class and partners of marks), marks are ordered by class behind
their base, base and marks are recomposed, and the stretch is put back.

No difference: width of characters and blanks, composition of accents and order of marks, characters without
a shape, compatibility characters, letters and hyphens of another script that look the same. A difference:
raised and lowered characters, case, accents, the number of blanks, line breaks. The mapping has one row for
each such code point of Unicode (below 40,000, fixed), so its broadcast is bounded; so is that of the stretches
with more than 1/4096 of all places (below 4,096 of at most HOT characters), which therefore are never shuffled to.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from notegrain.plans.shared import written

# Letters that look like a Latin letter, script by script, each above the letter it looks like;
# in the last lines letters of several scripts that look like each other and like no Latin one.
LOOK_ALIKE = (
    ("аеорсухѕіјһԁԛԝӏѵ", "aeopcyxsijhdqwlv"),
    ("АВЕКМНОРСТУХЅІЈԚԜѴӀ", "ABEKMHOPCTYXSIJQWVI"),
    ("αινορυγϲϳ", "aivopuycj"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    ("օոսհյցզՕՍ", "onuhjgqOU"),
    ("ɑɡᴏᴄᴠᴡᴢꜱᴜ", "agocvwzsu"),
    ("ⲟⲥⲣⲞⲤⲢⲎⲒⲔⲘⲚⲦⲨⲬ", "ocpOCPHIKMNTYX"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    ("ΓΠΦΛκⲄⲠⲪⲖⲕⲅⲡⲫ", "ГПФɅкГПФɅкгпф"),
    ("ĸᴋʙᴍʜᴛᴨⲃⲙⲏⲧτ", "кквмнтпвмнтт"),
    ("ꓥᴦφϕᴫ", "Ʌгффл"),
)
HOT = 256
USUAL, UNUSUAL = r"[\t-\r\x1c-\x7e]", r"[^\t-\r\x1c-\x7e]"
STRETCH = f"{USUAL}?{UNUSUAL}++"
"""Plain ASCII, anything else, and a stretch: a run of anything else with the plain character before it. All marks behind a base lie in its stretch."""
HYPHENS = "‐‑‒–⁃˗−➖Ⲻ﹘﹣－"
VISIBLE_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
SHAPELESS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
RAISED = ("<super>", "<sub>")
LINE_CONTROLS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"


@functools.cache
def _similar() -> dict[str, str]:
    out = {x: y for a, b in LOOK_ALIKE for x, y in zip(a, b, strict=True)} | dict.fromkeys(HYPHENS, "-")
    return out | {"⁄": "/"}


def shapeless(c: str) -> bool:
    kind, n = unicodedata.category(c), ord(c)
    if kind == "Cc":
        return c not in LINE_CONTROLS
    return kind == "Cf" and c not in VISIBLE_FORMATS or c in SHAPELESS or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF


@functools.cache
def form(c: str) -> str:
    """What one character is mapped to, before marks are ordered and recomposed."""
    if shapeless(c):
        return ""
    if c in _similar():
        return _similar()[c]
    if unicodedata.category(c) == "Zs":
        return " "
    if 0xAC00 <= ord(c) <= 0xD7A3:
        return c
    parts = unicodedata.decomposition(c).split()
    if not parts or parts[0] in RAISED:
        return c
    return "".join(form(chr(int(p, 16))) for p in parts if p[0] != "<")


@functools.cache
def _unicode() -> tuple[dict[str, str], dict[str, str], frozenset[str], frozenset[str]]:
    """mapping (characters that change or carry a class), composites (pair -> character), special characters, and those of them that join what stands before."""
    mapping, pairs, marks = {}, {}, set()
    for n in range(sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF:
            continue
        c = chr(n)
        d = unicodedata.decomposition(c)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
            a, b = (chr(int(p, 16)) for p in d.split())
            pairs[a + b] = c
            marks.add(b)
        if (f := form(c)) != c:
            mapping[c] = f
        if unicodedata.combining(c):
            marks.add(c)
    marks |= {chr(n) for n in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    special = {c for c, f in mapping.items() if unicodedata.normalize("NFC", f) != c} | marks
    return mapping, pairs, frozenset(special), frozenset(marks)


def _class(chars: set[str], leaf: int = 3) -> str:
    """A character class as a binary tree: half of the ranges are tested only within their own bounds, so a character is settled after a few bounds."""
    spans: list[list[int]] = []
    for n in sorted(map(ord, chars)):
        if spans and spans[-1][1] == n - 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    hexed = lambda lo, hi: f"\\x{{{lo:x}}}-\\x{{{hi:x}}}"

    def tree(part: list[list[int]]) -> str:
        if len(part) <= leaf:
            return "".join(hexed(*x) for x in part)
        halves = part[: len(part) // 2], part[len(part) // 2 :]
        return "".join(f"[[{hexed(h[0][0], h[-1][1])}]&&[{tree(h)}]]" for h in halves)

    return f"[{tree(spans)}]"


@functools.cache
def special() -> str:
    """Regular expression for one special character: a character that some rule touches."""
    chars = _unicode()[2]
    return f"[{_class({c for c in chars if ord(c) <= 127})}[[^\\x00-\\x7f]&&{_class({c for c in chars if ord(c) > 127})}]]"


def _compose(cps: Column) -> Column:
    """Text of ordered (c, ccc, joins, pairs): each mark joins its base where the two have a composite and nothing of its class or higher stands between."""
    state = F.struct(F.lit("").alias("out"), F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def jamo(a, b):
        x, y = F.ascii(a), F.ascii(b)
        lv = (x >= 0x1100) & (x < 0x1113) & (y >= 0x1161) & (y < 0x1176)
        lvt = (x >= 0xAC00) & (x <= 0xD7A3) & ((x - 0xAC00) % 28 == 0) & (y > 0x11A7) & (y < 0x11C3)
        code = F.when(lv, 0xAC00 + ((x - 0x1100) * 21 + (y - 0x1161)) * 28).when(lvt, x + y - 0x11A7)
        return F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def step(s, e):
        near = e["joins"] & (s["base"] != "") & F.when(e["ccc"] == 0, s["rest"] == "").otherwise(s["last"] < e["ccc"])
        joint = F.when(near, F.coalesce(F.get(F.filter(e["pairs"], lambda p: p["base"] == s["base"]), F.lit(0))["joint"], jamo(s["base"], e["c"])))
        new = e["ccc"] == 0

        def after(j):
            return F.struct(
                F.when(j.isNull() & new, F.concat(s["out"], s["base"], s["rest"])).otherwise(s["out"]).alias("out"),
                F.when(j.isNotNull(), j).when(new, e["c"]).otherwise(s["base"]).alias("base"),
                F.when(j.isNotNull(), s["rest"]).when(new, "").otherwise(F.concat(s["rest"], e["c"])).alias("rest"),
                F.when(j.isNotNull(), s["last"]).otherwise(e["ccc"]).alias("last"),
            )

        return F.element_at(F.transform(F.array(joint), after), 1)  # so that the look-up is made once

    return F.aggregate(cps, state, step, lambda s: F.concat(s["out"], s["base"], s["rest"]))


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """ch -> to (what a character is mapped to); c -> ccc, joins, pairs (of a mark: its class, and the bases it joins with the joint character)."""
    mapping, pairs, _, marks = _unicode()
    bases: dict[str, list[tuple[str, str]]] = {}
    for both, c in pairs.items():
        bases.setdefault(both[1], []).append((both[0], c))
    rows = [(c, unicodedata.combining(c), True, bases.get(c, [])) for c in sorted(marks)]
    return spark.createDataFrame(sorted(mapping.items()), "ch string, to string"), spark.createDataFrame(rows, "c string, ccc int, joins boolean, pairs array<struct<base:string,joint:string>>")


def _stretches(pieces: DataFrame) -> DataFrame:
    """piece, shown: the one form of each distinct stretch that shows anything.

    Code points are numbered by the bases up to them, and marks are ordered by class behind their base. From one
    character that joins nothing up to the next is a part, which is composed by itself, so that work is linear."""
    mapping, marks = _tables(pieces.sparkSession)
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("pos", "ch"))
    mapped = points.join(F.broadcast(mapping), "ch", "left").select("piece", "pos", F.posexplode(F.split(F.coalesce("to", "ch"), "")).alias("sub", "c")).filter("c <> ''")
    known = mapped.join(F.broadcast(marks), "c", "left").withColumns({"ccc": F.coalesce("ccc", F.lit(0)), "joins": F.coalesce("joins", F.lit(False))})
    upto = W.partitionBy("piece").orderBy("pos", "sub")
    numbered = known.withColumns({"base": F.sum((F.col("ccc") == 0).cast("int")).over(upto), "part": F.sum((~F.col("joins")).cast("int")).over(upto)})
    listed = numbered.groupBy("piece", "part").agg(F.array_sort(F.collect_list(F.struct("base", "ccc", "pos", "sub", "c", "joins", "pairs"))).alias("l"))
    parts = listed.select("piece", "part", F.when(F.size("l") == 1, F.element_at("l", 1)["c"]).otherwise(_compose(F.col("l"))).alias("s"))
    return parts.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "s"))), lambda x: x["s"]), "").alias("shown"))


def _touched() -> Column:
    return F.coalesce(F.regexp_replace("text", f"{USUAL}+", "").rlike(special()), F.lit(False))  # runs of plain ASCII are dropped first, which is cheap


def _cut(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys of the rows whose text is its own form (or null); keys and ``shown`` of the others. Each text is looked at once."""
    cut = F.arrays_zip(F.split("text", STRETCH, -1).alias("between"), F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0)).alias("piece"))
    places = written(rows.select(*keys, F.posexplode_outer(F.when(_touched(), cut)).alias("i", "z")).select(*keys, "i", "z.between", "z.piece"), "places")
    distinct = written(places.filter("piece is not null").groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    formed = _stretches(distinct.filter(F.col("piece").rlike(special())).select("piece"))
    own = F.when(~F.col("piece").rlike(special()), F.col("piece")).otherwise(F.lit(""))  # the others show nothing
    shown = written(distinct.join(formed, "piece", "left").select("piece", "n", F.coalesce("shown", own).alias("shown")), "shown")
    hot = (F.col("n") > F.lit(total // 4096)) & (F.length("piece") <= HOT)
    common = F.broadcast(shown.filter(hot).select("piece", F.col("shown").alias("common")))  # below 4,096 rows of at most HOT characters
    here = places.filter("i is not null").join(common, "piece", "left").withColumn("shown", F.when(F.col("piece").isNull(), F.lit("")).otherwise(F.col("common")))
    rest = here.filter("shown is null").drop("shown").join(shown.filter(~hot).select("piece", "shown"), "piece")
    every = here.filter("shown is not null").unionByName(rest).select(*keys, F.struct("i", F.concat("between", "shown").alias("s")).alias("e"))
    built = every.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["s"]), "").alias("shown"))
    return places.filter("i is null").select(*keys), built


def one_form(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, shown: every text in its one form; null stays null, empty stays empty. Keys must be unique."""
    rows = texts.select(key, F.col(text).alias("text"))
    _, built = _cut(rows.filter(_touched()), [key])
    return rows.filter(~_touched()).select(key, F.col("text").alias("shown")).unionByName(built)


def _forms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, own, form (digests) of the documents of texts that look the same and are not the same characters."""
    blank = r"\A[\s\p{Z}]*\z"
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.unhex(F.md5(F.col(text))).alias("own"), F.col(text).rlike(blank).alias("blank"), F.col(text).alias("text"))
    plain, built = _cut(rows, [key, "own", "blank"])
    forms = plain.filter("not blank").select(key, "own", F.col("own").alias("form")).unionByName(built.filter(~F.col("shown").rlike(blank)).select(key, "own", F.unhex(F.md5("shown")).alias("form")))
    rows = written(forms, "forms")
    split = rows.groupBy("form").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("form")
    return written(rows.join(split, "form", "left_semi"), "alike")


def look_alikes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key_a < key_b: texts that look the same and are not the same characters.

    Null, empty and blank texts (or texts of shapeless characters only) are no cases. Pairs are found between
    distinct texts and only then expanded to the documents that hold them, so repeats of one text, however
    many, are never paired with each other. ``alike_classes`` gives the same without pairs."""
    mine = _forms(texts, key, text)
    kinds = mine.select("form", "own").distinct()
    pairs = kinds.withColumnRenamed("own", "x").join(kinds.withColumnRenamed("own", "y"), "form").filter("x < y").select("x", "y")
    a = pairs.join(mine.select(F.col("own").alias("x"), F.col(key).alias("p")), "x").join(mine.select(F.col("own").alias("y"), F.col(key).alias("q")), "y")
    return a.select(F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b"))


def alike_classes(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class, spelling, n_spellings: of each document that ``look_alikes`` pairs, the least document that looks the
    same, the least one with the very same characters, and how many spellings the class has. Linear in the documents."""
    mine = _forms(texts, key, text)
    spelling = mine.groupBy("form", "own").agg(F.min(key).alias("spelling"))
    form = spelling.groupBy("form").agg(F.min("spelling").alias("class"), F.count(F.lit(1)).alias("n_spellings"))
    return mine.join(spelling, ["form", "own"]).join(form, "form").select(key, "class", "spelling", "n_spellings")
