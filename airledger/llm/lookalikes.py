"""One form for texts that look the same but are written with different characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_between

#: Characters that show nothing (controls, soft hyphen, joiners, zero-width and
#: direction marks, variation selectors, tags).
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]+"
)
#: Single blanks other than the space.
BLANKS = "\t" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: Look-alikes beside the published letters, by the form kept.
LOOKALIKES = {"Ԛ": "Q", "ӏ": "l", "µ": "μ", "‐": "-", "‑": "-"}
#: Letters that the published data joins with a Latin one though a reader tells them
#: apart: without a dot, of another build, without a bar, of another height.
TOLD_APART = "ıɩɪιꙇͺɑαɣγʏᶌỿყσſẝքƽƍгᴦꭇꭈꮁɯʋυտⴹƖǀƦɾ"
#: One sign for several characters that look the same.
LIGATURES = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "℃": "°C", "℉": "°F", "…": "..."}


@lru_cache
def published_letters() -> tuple[str, dict[str, str]]:
    """Version of the Unicode data, and the letters that look like a Latin one, by that letter.

    They are the confusables that the Unicode consortium publishes, as the library behind
    Spark's collations holds them: single letters and Roman numerals whose skeleton is that
    of a Latin letter of the same case, written from left to right, but for those that a
    reader tells apart. Digits, signs and Latin letters among each other stay as they are.
    """
    icu = SparkSession.active().sparkContext._jvm.com.ibm.icu
    skeletons = lambda chars: dict(zip(chars, checker.getSkeleton("\n".join(chars)).split("\n")))  # noqa: E731 - one call for all
    checker = getattr(icu.text, "SpoofChecker$Builder")().build()
    plain: dict[str, list[str]] = {}
    for letter, skeleton in skeletons([c for c in map(chr, range(65, 123)) if c.isalpha()]).items():
        plain.setdefault(skeleton, []).append(letter)
    others = [c for c in map(chr, (*range(0x80, 0x3000), *range(0xA000, 0xAC00))) if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Nl") and unicodedata.bidirectional(c) == "L" and c not in TOLD_APART]
    found = {}
    for c, skeleton in skeletons(others).items():
        fits = [x for x in plain.get(skeleton, []) if c.isupper() == x.isupper() or not (c.isupper() or c.islower())]
        if fits:
            found[c] = fits[0]  # capitals first: a letter without case looks like one
    return icu.lang.UCharacter.getUnicodeVersion().toString(), found


@lru_cache
def character_map() -> dict[str, str]:
    """Each character that has another look-alike form, by the form kept.

    Made from the published letters, the fixed values and two rules: wide, half-width and
    other type-face forms become ordinary ones, and a letter with accents follows its base
    letter.
    """
    letters = published_letters()[1] | LOOKALIKES
    made = dict.fromkeys(BLANKS, " ") | letters
    for code in (*range(0x2100, 0x2150), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)):
        kind = unicodedata.decomposition(chr(code)).partition(" ")[0]
        plain = unicodedata.normalize("NFKC", chr(code))
        if kind in ("<font>", "<wide>", "<narrow>") and len(plain) == 1:
            made[chr(code)] = letters.get(plain, plain)
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in letters:
            whole = unicodedata.normalize("NFC", letters[parts[0]] + parts[1:])
            if len(whole) == 1:
                made[chr(code)] = whole
    return made


def composed(text: Column) -> Column:
    """Canonical composition (NFC), by the Unicode library that Spark's collations use.

    The collation compares composed and combining accents alike, but only if several marks on
    one letter stand in canonical order, which this brings about.
    """
    return F.when(text.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)))


def skeleton(text: Column) -> Column:
    """`text` with invisible characters dropped and look-alikes brought to one form.

    An accent that a replaced letter carries may still be a combining mark; the collation
    treats it like the composed letter. Null stays null.
    """
    table = character_map()
    out = F.regexp_replace(text, INVISIBLE, "")
    out = composed(F.replace(out, F.lit("\r\n"), F.lit("\n")))
    out = F.translate(out, "".join(table), "".join(table.values()))
    for sign, plain in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


#: Sensitive to case and accents; one accented letter equals its letter with a combining mark.
COLLATION = "UNICODE"


def rough_key(form: Column) -> Column:
    """Hash of the ASCII letters and digits of a skeleton, its accents taken off.

    The collation never equates two forms that differ in it: each of these characters has a
    weight of its own. It only tells which texts need no comparing.
    """
    plain = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), form, F.lit(False))
    return F.xxhash64(F.regexp_replace(plain, "[^0-9A-Za-z]+", ""))


def _forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h1, h2, rough, form): two hashes that tell texts apart (128 bits), rough key and skeleton
    of each text. Written once, since several steps need them."""
    shown = df.where(F.col(text).isNotNull() & (F.col(text) != ""))
    made = shown.select(F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.col(text)).alias("h2"), skeleton(F.col(text)).alias("form"))
    return write_between(made.withColumn("rough", rough_key(F.col("form"))), "forms")


def _differ() -> Column:
    return (F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))


def _mixed_members(forms: DataFrame) -> DataFrame:
    """(key, h1, h2, class_id) of the texts in classes whose texts differ; class_id is the lowest key.

    Texts are grouped under the collation, and the classes joined back to them. Only texts
    that share their rough key with a different one take part; copies are brought together
    before each shuffle.
    """
    shared = forms.groupBy("rough").agg(_differ().alias("mixed")).where("mixed").select("rough")
    some = write_between(forms.join(shared, "rough", "left_semi").drop("rough"), "candidates")
    looks = some.withColumn("look", F.collate("form", COLLATION)).drop("form")
    classes = looks.groupBy("look").agg(F.min("key").alias("class_id"), _differ().alias("mixed")).where("mixed")
    classes = classes.select(F.col("look").alias("look_"), "class_id")
    return write_between(looks.join(classes, F.col("look") == F.col("look_")).select("key", "h1", "h2", "class_id"), "members")


def canonical_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, canonical): one row per row of `df`.

    Texts of equal look form a class; its canonical member is the one with the lowest key,
    and its skeleton is the form that all members get. An empty text stays empty and a null
    text null, each a class of its own. `key` must be unique.
    """
    forms = _forms(df, key, text)
    mixed = _mixed_members(forms).select("key", "class_id")
    alike = forms.groupBy("h1", "h2").agg(F.min("key").alias("first"))
    of = forms.select("key", "h1", "h2").join(alike, ["h1", "h2"]).join(mixed, "key", "left").select("key", F.coalesce("class_id", "first").alias("class_id"))
    chosen = forms.select(F.col("key").alias("form_id"), F.col("form").alias("canonical"))
    member = of.join(chosen, F.col("class_id") == F.col("form_id")).select("key", "class_id", "canonical")
    rest = df.where(F.col(text).isNull() | (F.col(text) == "")).select(F.col(key).alias("key"), F.col(key).alias("class_id"), F.col(text).alias("canonical"))
    return member.unionByName(rest).withColumnRenamed("key", key)


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): pairs of rows, smaller key first, whose texts look the same but differ.

    Differing texts of a class are paired first, their rows after that, so that many copies
    of one text cost no comparisons among themselves. Null and empty texts are no case.
    """
    members = _mixed_members(_forms(df, key, text))
    variants = members.select("class_id", "h1", "h2").distinct()
    other = variants.select(*(F.col(c).alias(f"{c}_") for c in variants.columns))
    differ = variants.join(other, (F.col("class_id") == F.col("class_id_")) & (F.struct("h1", "h2") < F.struct("h1_", "h2_"))).drop("class_id_")
    left = members.withColumnRenamed("key", "left_key")
    right = members.select(F.col("key").alias("right_key"), F.col("class_id").alias("class_r"), F.col("h1").alias("h1_r"), F.col("h2").alias("h2_r"))
    both = differ.join(left, ["class_id", "h1", "h2"]).join(
        right, (F.col("class_id") == F.col("class_r")) & (F.col("h1_") == F.col("h1_r")) & (F.col("h2_") == F.col("h2_r"))
    )
    return both.select(F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b"))
