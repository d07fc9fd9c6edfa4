"""Text rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import fixed as X


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{X.SPACE}+|{X.SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Strip and collapse whitespace runs to one space."""
    return F.trim(F.regexp_replace(c, f"{X.SPACE}+", " "))


# ---------------------------------------------------------------- script and shape


def has_kanji(c):
    return c.rlike(f"[{X.KANJI}]")


def kana_core(c):
    return F.regexp_replace(c, f"[^{X.KANA}]", "")


def to_hiragana(c):
    return F.translate(c, X.KATAKANA, X.HIRAGANA)


def stem(c):
    """Without trailing small っ/ッ and long marks."""
    return F.regexp_replace(c, "[っッー]+$", "")


def all_katakana(core):
    return core.rlike("[ァ-ヶ]") & ~core.rlike("[ぁ-ゖ]")


def is_repeat(core):
    """One unit twice or more, with up to two small or long marks behind it."""
    return (F.length(core) >= 4) & core.rlike(r"^([っッー]*[^っッー].*?)\1+[っッー]{0,2}$")


def is_broken(raw):
    """A pause between the first and the last kana."""
    return raw.rlike(f"[{X.KANA}](?s:.*)[{X.PAUSE}](?s:.*)[{X.KANA}]")


def asks(raw):
    return raw.rlike("[？?]")


def symbols_only(c):
    return (strip(c) != "") & ~c.rlike(X.WORDY)


# ---------------------------------------------------------------- answers


def plain_punctuation(c):
    out = F.translate(c, "".join(X.SWAPPED) + X.DROPPED, "".join(X.SWAPPED.values()))
    for mark, text in X.SPREAD.items():
        out = F.replace(out, F.lit(mark), F.lit(text))
    return out


def symbols_as_text(c):
    return squeeze(plain_punctuation(c))


def clean_answer(c):
    return squeeze(F.regexp_replace(plain_punctuation(F.coalesce(c, F.lit(""))), r"^[ .,:;\-–—]+", ""))


def restore_symbol(src: Column, answer: Column) -> Column:
    """The answer with the emotion symbol its source ends on, if it lost it."""
    out = strip(F.coalesce(answer, F.lit("")))
    wide = F.replace(F.replace(out, F.lit("！"), F.lit("!")), F.lit("？"), F.lit("?"))
    end = F.right(F.regexp_replace(src, f"{X.SPACE}+$", ""), F.lit(1))
    owes = end.isin(*X.EMOTION) & ~F.contains(wide, end)
    return F.when((F.coalesce(src, F.lit("")) == "") | (out == ""), out).when(owes, F.concat(wide, end)).otherwise(wide)


# ---------------------------------------------------------------- labels


def gated_text(text: Column, ink_ratio: Column) -> Column:
    """Recognised text, or '' for too little ink, invented readings and one character repeated."""
    bad = (ink_ratio < 0.015) | text.isin(*X.INVENTED) | text.rlike(r"^(.)\1{4,}$")
    return F.when(bad | text.isNull(), "").otherwise(text)


def with_shape(df: DataFrame, text: Column, prefix: str = "_") -> DataFrame:
    """Adds the stripped text, kana core, hiragana and stem the rule chain reads.

    They are columns of their own step because the chain uses each several times; as one
    expression every use would run its regular expressions again.
    """
    p = prefix
    df = df.withColumn(p + "raw", strip(text)).withColumn(p + "core", kana_core(F.col(p + "raw")))
    core = F.col(p + "core")
    return df.withColumns({p + "hira": to_hiragana(core), p + "root": to_hiragana(stem(core)), p + "rep": is_repeat(core)})


def label(in_parent: Column, before: Column | None = None, prefix: str = "_") -> Column:
    """SFX or DIALOGUE by the ordered rule chain; empty or unreadable text keeps its label."""
    raw, core, hira, root, rep = (F.col(prefix + n) for n in ("raw", "core", "hira", "root", "rep"))
    n = F.length(core)
    known = core.isin(*X.SOUNDS)
    outside = F.when(n <= 3, True).when(core.rlike("[っッー]"), n <= 8).otherwise(rep | known)
    inside = (
        F.when(hira.isin(*X.DIALOGUE) | ((root != "") & root.isin(*X.DIALOGUE)), False)
        .when(rep | known | hira.isin(*X.SOUNDS), True)
        .when((n <= 6) & all_katakana(core) & core.rlike("[っッ]$") & ~(asks(raw) | is_broken(raw)), True)
        .otherwise((root != "") & F.concat(root, root).isin(*X.SOUNDS))
    )
    sound = F.when(in_parent, inside).otherwise(outside)
    kept = F.lit("DIALOGUE") if before is None else before
    return (
        F.when((raw == "") | (kept == "UNREADABLE"), kept)
        .when(has_kanji(raw) | (core == "") | core.isin(*X.DIALOGUE), "DIALOGUE")
        .otherwise(F.when(sound, "SFX").otherwise("DIALOGUE"))
    )
