"""Text that looks the same brought to one form of characters.

The table of look-alikes isn't kept here: it follows from the Unicode data of
the ICU library that comes with Spark (the prototypes of UTS 39) and of Python,
by the rules in :func:`prototypes`. The texts are rewritten by SQL in DuckDB,
inside the Arrow batches of each partition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.runtime import map_arrow, materialize, spread_scan

# Kinds of compatibility characters that look different from what they stand for.
_RAISED_LOWERED_CIRCLED = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
# Letters that a missing dot tells apart from those with one.
_DOTLESS = "ıȷ"
# Invisible characters that aren't format characters (grapheme joiner, fillers, inherent vowels, variation selectors).
_INVISIBLE = r"\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0000}-\x{E0FFF}"
# Of two-letter prototypes, the single sign that ASCII has for them.
_JOINED = {"rn": "m", "''": '"'}

#: Invisible characters: format characters and the above. A joiner between two pictures is kept, since it makes them one.
_HIDDEN = rf"[\p{{Cf}}{_INVISIBLE}]"
_PICTURE_JOINER = r"([\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]\x{FE0F}?)\x{200D}([\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}])"
_KEPT_JOINER = "\ue000"


def _is_kept(c: str) -> bool:
    return c in _DOTLESS or unicodedata.decomposition(c).split(" ")[0] in _RAISED_LOWERED_CIRCLED


def _same_case(c: str, p: str) -> bool:
    a = c.isupper() or unicodedata.category(c) == "Lt"
    return a == p.isupper() or not (c.isalpha() and p.isalpha() and len(p) == 1 and p.isascii())


@lru_cache(maxsize=1)
def _table(key: str, skeletons: tuple[str, ...], points: tuple[int, ...]) -> dict[str, str]:
    base: dict[str, str] = {}
    for point, skeleton in zip(points, skeletons):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind == "Zs":
            base[c] = " "
            continue
        if _is_kept(c) or kind == "Cf":
            continue
        shape = unicodedata.decomposition(c).split(" ")[0]
        p = unicodedata.normalize("NFKC", c) if shape in ("<wide>", "<narrow>") else _JOINED.get(skeleton, skeleton)
        if c.isupper() and p == "l":
            p = "I"
        if p != c and _same_case(c, p):
            base[c] = p
    out = {}
    for point in points:
        c = chr(point)
        if _is_kept(c):
            continue
        parts = unicodedata.normalize("NFD", c) if c not in base else base[c]
        p = unicodedata.normalize("NFC", "".join(base.get(x, x) for x in parts))
        if p != c and p != unicodedata.normalize("NFC", c):
            out[c] = p
    return out


def prototypes(spark: SparkSession) -> dict[str, str]:
    """What each character beyond ASCII that looks like another is written as.

    ASCII characters stay as they are, so that 0 and O, or 1, l and I, are kept
    apart. Spaces of any kind become a space; full-width and half-width forms what
    they stand for; other characters the prototype of their shape, but only one
    of the same case. Raised, lowered, circled and fraction forms and dotless
    letters stay. Accented letters get the prototype of the bare letter and keep
    their accent. Left out are Hangul syllables, whose prototypes only spell them
    in single letters (no two have the same), and the variation selectors from
    U+E0000 on, which are taken out as invisible.
    """
    points = tuple(p for p in range(0x80, 0xE0000) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co", "Cc") and not 0xAC00 <= p <= 0xD7A3)
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    # One call for all characters; a line end is its own prototype and separates them.
    skeletons = tuple(checker.getSkeleton("\n".join(map(chr, points))).split("\n"))
    return _table(unicodedata.unidata_version, skeletons, points)


def _sql(table: dict[str, str], found: list[str], first: str) -> str:
    """The expression for texts in which these characters occur."""

    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = [c for c in found if c in table]
    one = [c for c in known if len(table[c]) == 1]
    out = first
    if one:
        out = f"translate({out}, {quote(''.join(one))}, {quote(''.join(table[c] for c in one))})"
    for c in known:
        if len(table[c]) != 1:
            out = f"replace({out}, {quote(c)}, {quote(table[c])})"
    return f"replace(nfc_normalize({out}), {quote(_KEPT_JOINER)}, {quote(chr(0x200D))})"


def _rewrite(table: dict[str, str], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pa.Table.from_batches([batch])
            con.register("texts", texts)
            exprs = []
            for c in columns:
                name = '"' + c.replace('"', '""') + '"'
                joined = f"regexp_replace({name}, '{_PICTURE_JOINER}', '\\1{_KEPT_JOINER}\\2', 'g')"
                seen = rf"regexp_replace(replace(replace({joined}, chr(9), ' '), chr(0), ''), '{_HIDDEN}', '', 'g')"
                # Hangul is composed first: its single letters have prototypes of their own, syllables don't.
                seen = rf"CASE WHEN regexp_matches({name}, '[\x{{1100}}-\x{{11FF}}]') THEN nfc_normalize({seen}) ELSE {seen} END"
                seen = f"CASE WHEN regexp_full_match({name}, '[ -~]*') THEN {name} ELSE {seen} END"
                # Most batches use few characters; the tables are cut to those that occur.
                found = con.sql(
                    f"SELECT DISTINCT unnest(regexp_extract_all({name}, '[^\\x00-\\x7F]')) FROM texts WHERE NOT regexp_full_match({name}, '[ -~]*')"
                ).fetchall()
                exprs.append(f"CASE WHEN regexp_full_match({name}, '[ -~]*') THEN {name} ELSE {_sql(table, sorted(r[0] for r in found), seen)} END AS {name}")
            rest = [f'"{n}"' for n in batch.schema.names if n not in columns]
            result = con.sql(f"SELECT {', '.join(rest + exprs)} FROM texts").to_arrow_table()
            con.unregister("texts")
            yield from result.select(batch.schema.names).cast(batch.schema).to_batches()
        con.close()

    return run


def canonical_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the texts in ``columns`` in one form, so that equal-looking ones are equal.

    Invisible characters are taken out, look-alikes replaced by their prototypes
    (see :func:`prototypes`) and accents composed. Case, accents, dots and raised
    or circled forms are kept. A null stays null, an empty text empty; texts are
    rewritten whole. The result of rewriting twice is that of rewriting once.
    """
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    if missing := [c for c in columns if c not in strings]:
        raise ValueError(f"not text columns: {missing}")
    return map_arrow(df, _rewrite(prototypes(df.sparkSession), columns), df.schema)


def canonical_paths(paths: DataFrame) -> DataFrame:
    """(path_id, segment_form, full_path_form) of every row of ``paths``."""
    names = paths.select(F.col("id").alias("path_id"), F.col("segment").alias("segment_form"), F.col("full_path").alias("full_path_form"))
    return canonical_text(names, ["segment_form", "full_path_form"])


#: Rows of a form on one side of a task's pairs, about.
PAIR_ROWS = 1000


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f, t): 128-bit hashes of each row's form and text, as two numbers each; written.

    From here on only numbers travel, no texts. Rows with a null id or text are left out.
    """
    given = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    forms = canonical_text(spread_scan(given).withColumn("form", F.col("text")), ["form"])
    hashes = [F.xxhash64(F.lit(seed), of).alias(f"{of[0]}{seed}") for of in ("form", "text") for seed in (1, 2)]
    return materialize(forms.select("id", *hashes), "form-keys")


_FORM, _TEXT = ["f1", "f2"], ["t1", "t2"]


def lookalike_classes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_links): each row's class of equal-looking texts, and how many rows look alike but differ.

    ``class_id`` is the lowest id of the class; a row that nothing looks like is a
    class of its own. Rows of equal text are in the same class without a link
    between them. A repeated row comes out as often as it is given and counts as often.
    """
    keyed = _keyed(rows, id_col, text_col)
    texts = keyed.groupBy(*_FORM, *_TEXT).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    forms = texts.groupBy(*_FORM).agg(F.sum("n").alias("n_form"), F.min("least").alias("class_id"))
    known = materialize(texts.join(forms, _FORM).select(*_TEXT, "class_id", (F.col("n_form") - F.col("n")).alias("n_links")), "classes")
    return keyed.join(known, _TEXT).select(F.col("id").alias(id_col), "class_id", "n_links")


def lookalike_pairs(rows: DataFrame, id_col: str, text_col: str, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ in characters but have one form.

    A form with a single text ends before anything is joined. The rows of a form
    with many are dealt out over several tasks, each of which pairs about
    ``pair_rows`` with all.
    Rows with a null id or text are left out; repeated rows count once.
    """
    keyed = _keyed(rows, id_col, text_col)
    range_of = [F.min(t).alias(f"low_{t}") for t in _TEXT] + [F.max(t).alias(f"high_{t}") for t in _TEXT]
    several = (F.col("low_t1") != F.col("high_t1")) | (F.col("low_t2") != F.col("high_t2"))
    deals = F.ceil(F.col("n") / pair_rows).cast("int").alias("deals")
    shared = materialize(keyed.groupBy(*_FORM).agg(F.count(F.lit(1)).alias("n"), *range_of).where(several).select(*_FORM, deals), "shared-forms")
    members = materialize(keyed.join(shared, _FORM).distinct(), "members")
    a = members.select(*_FORM, F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"), F.col("id").alias("id_a"), *[F.col(t).alias(f"a_{t}") for t in _TEXT])
    b = members.select(*_FORM, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("id").alias("id_b"), *[F.col(t).alias(f"b_{t}") for t in _TEXT])
    differ = (F.col("a_t1") != F.col("b_t1")) | (F.col("a_t2") != F.col("b_t2"))
    return a.join(b, [*_FORM, "deal"]).where((F.col("id_a") < F.col("id_b")) & differ).select("id_a", "id_b")


def lookalike_paths(paths: DataFrame) -> DataFrame:
    """(path_id_a, path_id_b): rows of ``paths`` whose full_paths look alike but aren't the same."""
    pairs = lookalike_pairs(paths, "id", "full_path")
    return pairs.select(F.col("id_a").alias("path_id_a"), F.col("id_b").alias("path_id_b"))


def path_classes(paths: DataFrame) -> DataFrame:
    """(path_id, class_id, n_links) of the rows of ``paths`` with a full_path."""
    return lookalike_classes(paths, "id", "full_path").withColumnRenamed("id", "path_id")
