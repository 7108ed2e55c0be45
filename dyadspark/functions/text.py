"""Column functions on names, paths, ids and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dyadspark.constants import BACKCHANNELS

WORD = r"(?U)\b[\w']+\b"
SPEAKER = r"(?U)\b(P[0-9A-Z]+):"


def parse_stem(stem: Column) -> Column:
    """``vendor_SxxIxxPxx`` names: vendor, and the other three parts without their first letter; null unless four parts."""
    parts = F.split(stem, "_", -1)
    rest = lambda i: F.substring(parts[i], 2, 1 << 30)
    return F.when(F.size(parts) == 4, F.struct(parts[0].alias("vendor"), rest(1).alias("session"), rest(2).alias("interaction"), rest(3).alias("participant")))


def canonical_participant_id(raw: Column) -> Column:
    """Trimmed, with exactly one leading ``P`` taken off and one put on."""
    return F.concat(F.lit("P"), F.regexp_replace(F.trim(raw), "^P", ""))


def source_dataset_split(path: Column) -> Column:
    """The one path component among train, dev and test; null if there is none or more than one."""
    found = F.filter(F.split(path, "/"), lambda x: x.isin("train", "dev", "test"))
    return F.when(F.size(found) == 1, found[0])


def split_of(source_split: Column) -> Column:
    return F.when(source_split == "test", "test").when(source_split.isNotNull(), "train")


def normalize_relationship_detail(relationship: Column, detail: Column) -> Column:
    text = F.trim(F.coalesce(detail, F.lit("")))
    return F.when((text == "") | (text == "stranger") | (F.trim(F.coalesce(relationship, F.lit(""))) == "stranger"), "UNKNOWN").otherwise(text)


def dyad_id(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "|")


def pair_id(interaction: Column, prompt: Column, response: Column, turn: Column) -> Column:
    return F.format_string("%s|%s|%s|%04d", interaction, prompt, response, turn)


def parse_row_dir(name: Column) -> Column:
    """``row_<i>_p1_P<a>_p2_P<b>``; null where the name has another form."""
    pattern = "^row_(.+)_p1_(P[^_]+)_p2_(P[^_]+)$"
    get = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(get(1).alias("row_id"), get(2).alias("p1"), get(3).alias("p2")))


def normalize_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def words_to_text(words: Column) -> Column:
    return F.trim(F.array_join(F.transform(words, lambda w: w["word"]), " "))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))


def first_speaker(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), SPEAKER, 1)


def last_speaker(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPEAKER), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("")


def participant_fallback(speakers: Column, index: int) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(speakers, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.get(parts, F.lit(index)), F.lit(""))


def turn_index_of(stem: Column) -> Column:
    """Digits after the last ``_`` as a long; null if there are none or they are too many for one."""
    return F.regexp_extract(stem, r"_([0-9]+)$", 1).try_cast("bigint")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def resolve_path(root: str | Column, path: Column) -> Column:
    """Absolute paths stay, relative ones go under the root, empty ones are null."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(F.coalesce(path, F.lit("")) == "", None).when(path.startswith("/"), path).otherwise(F.concat_ws("/", root, path))


def candidate_pair_id(model: Column, split: Column, style: Column, prompt_stem: Column, response_stem: Column) -> Column:
    return F.concat_ws("|", F.translate(model, "|/", "__"), split, style, prompt_stem, response_stem)


def number_text(x: Column) -> Column:
    """Plain decimal text of a number rounded to six places, at least one of them kept: 0.0005, 12345678.5, 3.0, -0.0.

    Rounding is that of doubles, half away from zero after a product with a million, and digits are those of the double
    itself, as SQL's ``printf`` writes them (from 2^63 on those of its shortest text). Null stays null.
    """
    x = x.cast("double")
    size = F.round(F.abs(x) * 1e6) / 1e6
    size = F.when(size < float("inf"), size).otherwise(F.abs(x))  # the product overflowed
    whole, part = F.floor(size), F.rint((size - F.floor(size)) * 1e6).cast("long")
    plain = F.concat((whole + F.floor(part / 1_000_000)).cast("string"), F.lit("."), F.lpad((part % 1_000_000).cast("string"), 6, "0"))
    plain = F.when(size < float(1 << 63), plain).otherwise(F.format_string("%.6f", size))
    fixed = F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")
    # the text of -0.0 is the one place where its sign shows
    minus = F.when((x < 0) | x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(minus, F.lit("inf"))).when(x.isNotNull(), F.concat(minus, fixed))


def merge_key(columns: Sequence[str], numbers: Sequence[str] = ("prompt_start_s", "prompt_end_s", "response_start_s", "response_end_s")) -> Column:
    """Key text for output; joins use the typed columns. A key that lacks a part is null, as it would read like another."""
    parts = [number_text(F.col(c)) if c in numbers else F.col(c).cast("string") for c in columns]
    return F.concat(*[x for part in parts for x in (F.lit("|"), part)][1:])


def artifact_name(pair: Column, key: Column, role: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(pair, r"\|", "__"), r"[/\\]", "_")
    return F.concat(safe, F.lit("__"), F.substring(F.sha1(key), 1, 12), F.lit("__"), role)


def is_backchannel(transcript: Column, words: Column, lexicon: Sequence[str] = BACKCHANNELS, most_words: int = 3) -> Column:
    """The whole text is in the lexicon, or it has few words and each of them is."""
    tokens = F.filter(F.transform(words, lambda w: normalize_text(w["word"])), lambda t: t != "")
    few = (F.size(words) <= most_words) & (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(*lexicon))
    return normalize_text(F.coalesce(transcript, F.lit(""))).isin(*lexicon) | F.coalesce(few, F.lit(False))
