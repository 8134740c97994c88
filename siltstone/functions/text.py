"""Text as Column expressions: stripping, tokens, similarity, grounding."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no evidence of their own.
GROUNDING_IGNORED = ("a", "an", "the", "be", "been", "being", "is", "are", "was", "were")
#: Words that do not tie a question to a claim, besides those above.
RELEVANCE_IGNORED = (
    "and", "audio", "caption", "claim", "classified", "classification", "clip", "contradicted", "contradiction", "description",
    "determine", "determines", "determining", "does", "event", "evidence", "from", "heard", "how", "into", "judgment", "recording",
    "scene", "should", "sound", "sounds", "source", "statement", "supported", "supporting", "that", "this", "what", "whether", "which", "with",
)
#: Phrases that argue from what a caption leaves out.
ABSENCE_PHRASES = ("not mentioned", "does not mention", "no caption", "absent from the caption", "absence from the caption", "not in the captions")


#: Unicode white space and the four separators that count as such.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim takes spaces alone)."""
    return F.btrim(text, F.lit(_SPACES))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def words(text: Column) -> Column:
    """Parts between white space, none for blank text."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


@functools.cache
def _expansions() -> list[tuple[str, str]]:
    """Characters whose case folding is not their lower case, found by rule; letters that a lower-case text cannot hold are left out."""
    return [(c, f) for c in map(chr, range(0x80, 0x1FFFF)) if (f := c.casefold()) != (low := c.lower()) and c.isalnum() for c in {c, low} if len(c) == 1 and c.casefold() == f]


def _ranges(chars: list[str]) -> str:
    """A character class of these characters, neighbours as ranges."""
    codes, parts = sorted(map(ord, chars)), []
    for code in codes:
        if parts and code == parts[-1][1] + 1:
            parts[-1][1] = code
        else:
            parts.append([code, code])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in parts) + "]"


#: A range that holds every letter with a folding of its own but the sharp s: a text without any of it is looked through once, and quickly.
_BEYOND_LATIN = "[\u00b5\u0100-\U0001ffff]"


def casefold(text: Column) -> Column:
    """Unicode case folding: lower case, then what folds further.

    A capital sigma goes first, as lower case makes two letters of it. The long
    list of rare letters is gone through only for a text that holds one.
    """
    one, many = [("\u03a3", "\u03c3")], []
    for char, folded in sorted(set(_expansions()) - {("\u00df", "ss")}):
        (one if len(folded) == 1 else many).append((char, folded))
    letters = _ranges([c for c, _ in [*one, *many]])

    def folded(t: Column) -> Column:
        out = F.translate(t, "".join(c for c, _ in one), "".join(f for _, f in one))
        for char, plain in many:
            out = F.replace(out, F.lit(char), F.lit(plain))
        rare = t.rlike(_BEYOND_LATIN) & t.rlike(letters)
        return F.lower(F.replace(F.when(rare, out).otherwise(t), F.lit("\u00df"), F.lit("ss")))

    return F.get(F.transform(F.array(text), folded), F.lit(0))  # so that the text itself is made once


def lexical_tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-case text; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeated items; 0 if both are empty."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(all_ == 0, F.lit(0.0)).otherwise(both / (all_ - both))


def folded_words(text: Column, besides: str = "") -> Column:
    """Case-folded runs of letters and digits, and of the characters ``besides``."""
    return F.filter(F.split(casefold(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{besides}]+", " ")), " "), lambda w: w != "")


def grounding_tokens(text: Column) -> Column:
    return F.filter(folded_words(text), lambda w: ~w.isin(*GROUNDING_IGNORED))


def relevance_tokens(text: Column) -> Column:
    return F.filter(folded_words(text), lambda w: ~w.isin(*GROUNDING_IGNORED, *RELEVANCE_IGNORED) & (F.char_length(w) >= 3))


def normalized(text: Column) -> Column:
    """Case-folded letters and digits, single spaces."""
    return F.array_join(folded_words(text), " ")


def _padded(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


#: A character that is no letter and no digit; captions lose theirs.
_MARK = "\x01"


def holds_phrase(caption: Column, phrase: Column) -> Column:
    """Whether the phrase's grounding tokens stand next to each other in the caption; tokens hold no spaces, so padding marks their ends."""
    return is_grounded(F.array(caption), phrase)


def is_grounded(captions: Column, phrase: Column) -> Column:
    """Whether some caption holds the phrase.

    The captions are joined, with a mark that no word has between them, and
    folded in one go; a phrase has no mark, so it can't reach from one into the
    next. An array of one hands the phrase to the walk.
    """
    return is_said(as_one(captions), phrase)


def as_one(captions: Column) -> Column:
    """Captions as one text, with a mark between them."""
    return F.array_join(F.transform(captions, lambda c: F.replace(c, F.lit(_MARK), F.lit(" "))), f" {_MARK} ")


def is_said(said: Column, phrase: Column) -> Column:
    """Whether captions (see as_one) hold the phrase.

    A phrase that stands there letter by letter, between what is no letter and no
    digit (nor half of a letter beyond the first plane), has its tokens there,
    too: only for others the captions are folded.
    """
    folded = casefold(F.regexp_replace(said, rf"[^\p{{L}}\p{{N}}{_MARK}]+", " "))
    tokens = F.regexp_replace(F.concat(F.lit(" "), F.trim(folded), F.lit(" ")), f" (?:{'|'.join(GROUNDING_IGNORED)})(?= )", "")
    plain = F.contains(said, phrase) & ~F.contains(phrase, F.lit(_MARK)) & ~F.contains(phrase, F.lit("\\E"))
    literal = plain & F.rlike(said, F.concat(F.lit(r"(?<![\p{L}\p{N}\p{Cs}])\Q"), phrase, F.lit(r"\E(?![\p{L}\p{N}])")))
    asked = F.filter(F.array(_padded(grounding_tokens(phrase))), lambda p: F.trim(p) != "")
    return F.coalesce(F.exists(asked, lambda p: F.when(literal, True).otherwise(F.contains(tokens, p))), F.lit(False))


def is_relevant(question: Column, claim: Column) -> Column:
    """Whether a word of the question is related to one of the claim."""
    claimed = F.array(relevance_tokens(claim))
    asked = relevance_tokens(question)
    return F.coalesce(F.exists(claimed, lambda words: F.exists(asked, lambda q: F.exists(words, lambda c: related(q, c)))), F.lit(False))


def related(a: Column, b: Column) -> Column:
    """Equal, or the shorter one has four letters or more and begins the longer one."""
    return (a == b) | ((F.char_length(a) >= 4) & F.startswith(b, a)) | ((F.char_length(b) >= 4) & F.startswith(a, b))


def argues_from_absence(text: Column) -> Column:
    return F.lower(text).rlike("|".join(ABSENCE_PHRASES))


def nonblank(items: Column) -> Column:
    """Stripped items, blank and null ones left out; null gives none."""
    return F.coalesce(F.filter(F.transform(items, lambda x: strip(F.coalesce(x.cast("string"), F.lit("")))), lambda x: x != ""), F.array().cast("array<string>"))


def caption_groups(text: Column) -> Column:
    """Lists of captions out of a JSON text: an item that is no list is a list of one, a null item an empty list; captions are stripped, blank ones left out. What is no list gives none."""
    lists = F.from_json(text, "array<string>")  # items that are lists or objects as their JSON text
    inner = lambda x: F.coalesce(F.when(F.startswith(x, F.lit("[")), F.from_json(x, "array<string>")), F.array(x))
    return F.coalesce(F.when(F.startswith(F.ltrim(text), F.lit("[")), F.transform(lists, lambda x: F.when(x.isNull(), F.array().cast("array<string>")).otherwise(nonblank(inner(x))))), F.array().cast("array<array<string>>"))


def split_keywords(text: Column) -> Column:
    return nonblank(F.when(F.contains(text, F.lit(";")), F.split(text, ";")).otherwise(F.split(text, ",")))


def rotating_window(items: Column, limit: int, offset: Column) -> Column:
    """All items if few; else ``limit`` of them from offset on, around the end."""
    return _window(nonblank(items), limit, offset)


def _window(clean: Column, limit: int, offset: Column) -> Column:
    if limit < 1:
        return clean
    n = F.size(clean)
    return F.when(n <= limit, clean).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.element_at(clean, (F.pmod(offset + i, n) + 1).cast("int"))))


def source_labels(count: Column) -> Column:
    """AUDIO_1 to AUDIO_count; none below one."""
    return F.when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat(F.lit("AUDIO_"), i.cast("string"))))


def selected_labels(count: Column, sources: Column, *texts: Column) -> Column:
    """Labels that a target uses or its texts name, in order; all where it names none."""
    labels = source_labels(count)
    named = F.array_union(sources, F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit("AUDIO_[1-9][0-9]*"), F.lit(0)))
    chosen = F.filter(labels, lambda x: F.array_contains(named, x))
    return F.when(F.size(chosen) > 0, chosen).otherwise(labels)


def render_context(captions: Column, labels: Column, chosen: Column, limit: int, offset: Column, clean: bool = False) -> Column:
    """A block of caption lines for each chosen label; '- none' for a source without captions. Clean captions are nonblank already."""
    window = _window if clean else rotating_window

    def block(label: Column, i: Column) -> Column:
        shown = window(F.get(captions, i), limit, offset)
        lines = F.when(F.size(shown) > 0, F.transform(shown, lambda c: F.concat(F.lit("- "), c))).otherwise(F.array(F.lit("- none")))
        return F.array_join(F.concat(F.array(F.concat(label, F.lit(" captions:"))), lines), "\n")

    blocks = F.transform(labels, lambda label, i: F.when(F.array_contains(chosen, label), block(label, i)))
    return F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n\n")


def render_feedback(errors: Column, stage: Column | None = None, items: int = 2, length: int = 360) -> Column:
    """The stage's last errors as list items, cut with an ellipsis; 'None.' without any."""
    own = errors if stage is None else F.filter(errors, lambda e: F.startswith(e, F.concat(stage, F.lit(" attempt "))))
    last = F.slice(own, F.greatest(F.size(own) - items + 1, F.lit(1)), F.lit(items))

    def item(e: Column) -> Column:
        text = collapse(e)
        short = F.concat(F.regexp_replace(F.substring(text, 1, length - 3), r"(?U)\s+$", ""), F.lit("..."))
        return F.concat(F.lit("- "), F.when(F.char_length(text) > length, short).otherwise(text))

    return F.when(F.coalesce(F.size(own), F.lit(0)) < 1, F.lit("None.")).otherwise(F.array_join(F.transform(last, item), "\n"))


def render_template(template: str, **values: Column) -> Column:
    """``{{name}}`` places filled from columns; a place without a value is an error."""
    import re

    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    missing = sorted({n for n in parts[1::2] if n not in values})
    if missing:
        raise KeyError(f"no value for {missing}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for i, p in enumerate(parts)])
