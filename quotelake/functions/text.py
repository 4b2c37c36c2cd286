"""Column functions for passages and utterances; all of them run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelake.functions import words as W


def _marks() -> tuple[str, str]:
    """Lower-case letters with marks and, in their order, the letters without; marks on their own stand behind, with
    nothing. From the characters below U+2000, all marked letters of Latin, Greek and Cyrillic."""
    letters, bare, alone = [], [], []
    for c in map(chr, range(0xC0, 0x2000)):
        first, *rest = unicodedata.normalize("NFD", c)
        if unicodedata.category(c) == "Mn":
            alone.append(c)
        elif rest and all(unicodedata.category(x) == "Mn" for x in rest):
            letters.append(c)
            bare.append(first)
    return "".join(letters + alone), "".join(bare)


MARKED, PLAIN = _marks()
#: Stems of this many letters stand for a word.
STEM = 5


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as a lambda's variable; a column is evaluated wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without marks; letters such as ß and œ stay."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def fragment(text: Column) -> Column:
    """Folded letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def reference_key(text: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(text), "[^a-z0-9]", "")


def tokens(text: Column) -> Column:
    """The words of a fragment, an empty array for none."""
    return F.filter(F.split(fragment(text), " "), lambda w: w != "")


def stems(text: Column, least: int = 4, stop: tuple[str, ...] = ()) -> Column:
    """Distinct first letters of the words of at least `least` letters that are no stop words."""
    kept = F.filter(tokens(text), lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, STEM)))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, found).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def overlap(spoken: Column, passage: Column) -> Column:
    """The share of the spoken stems that the passage has, 0 without stems."""
    return bound(spoken, lambda s: F.when(F.size(s) > 0, F.size(F.array_intersect(s, passage)) / F.size(s)).otherwise(F.lit(0.0)))


def ordered_coverage(query: Column, words: Column) -> Column:
    """The share of query words found one after another in words; stops at the first that is missing."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hit"), F.lit(True).alias("on"))

    def step(words: Column, s: Column, w: Column) -> Column:
        found = F.array_position(F.slice(words, s["at"] + 1, F.greatest(F.size(words), F.lit(1))), w).cast("int")
        go = s["on"] & (found > 0)
        return F.struct(F.when(go, s["at"] + found).otherwise(s["at"]).alias("at"), F.when(go, s["hit"] + 1).otherwise(s["hit"]).alias("hit"), go.alias("on"))

    def share(q: Column) -> Column:
        hit = bound(words, lambda ws: F.aggregate(q, start, lambda s, w: step(ws, s, w), lambda s: s["hit"]))
        return F.when(F.size(q) > 0, hit / F.size(q)).otherwise(F.lit(0.0))

    return bound(query, share)


def last_words(text: Column, n: int) -> Column:
    """The last n words of a text, joined by a space."""
    w = F.filter(F.split(F.trim(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return bound(w, lambda x: F.array_join(F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n), " "))


def last_sentence(text: Column, n: int) -> Column:
    """The last words of the last sentence, with the sentence before it where it has under four words."""
    parts = F.filter(F.transform(F.split(text, r"[.!?;\n]+"), lambda s: F.trim(s)), lambda s: s != "")

    def chosen(p: Column) -> Column:
        last = F.coalesce(F.get(p, F.size(p) - 1), F.lit(""))
        short = F.size(F.split(last, r"[\x20\x09-\x0D]+")) < 4
        return F.when(short & (F.size(p) > 1), F.concat(F.get(p, F.size(p) - 2), F.lit(" "), last)).otherwise(last)

    return last_words(bound(parts, chosen), n)


def safe_name(name: Column, suffix: str) -> Column:
    """Lower-case letters and digits with single dashes, a fixed name where nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(fold(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(clean == "", F.lit("session")).otherwise(clean), F.lit(suffix))


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version with an optional leading v; parts that are no numbers count as 0."""
    return F.transform(F.split(F.regexp_replace(F.trim(version), "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(0)))


def cosine_dot(a: Column, b: Column) -> Column:
    """The sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def indexed(text: Column) -> Column:
    """The form in which first words are indexed: folded words, digits and apostrophes, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"(?U)[^\w\s']", " "), r"(?U)\s+", " "))


def significant(text: Column) -> Column:
    """The words of hashed retrieval: three letters or more, no stop words."""
    return F.filter(tokens(text), lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(W.HASH_STOP)))


def cache_key(text: Column) -> Column:
    """Folded, single spaces, at most 1,200 characters."""
    return F.substring(F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " ")), 1, 1200)


def content_stems(text: Column) -> Column:
    """Distinct stems that can confirm a passage: of words of four letters or more, without stop words and weak stems.
    Apostrophes and hyphens part words, other marks are left out of them."""
    parted = F.trim(F.regexp_replace(F.regexp_replace(fold(text), "['-]", " "), r"(?U)\s+", " "))
    # marks are left out of the whole text, not of one word after another
    bare = F.split(F.regexp_replace(parted, r"[^\p{L}\p{N} ]+", ""), " ")
    kept = F.filter(bare, lambda w: (F.length(w) >= 4) & ~w.isin(*sorted(W.STEM_STOP)))
    return F.array_distinct(F.filter(F.transform(kept, lambda w: F.substring(w, 1, STEM)), lambda w: ~w.isin(*sorted(W.WEAK_STEMS))))


def best_overlap(spoken: Column, texts: Column) -> Column:
    """The largest share of the spoken stems that one of several texts has."""
    own = content_stems(spoken)
    return bound(own, lambda s: F.coalesce(F.array_max(F.transform(texts, lambda t: overlap(s, content_stems(t)))), F.lit(0.0)))


def without_attribution(text: Column) -> Column:
    """A quotation without who said it ('Paul dit', 'il est écrit')."""
    for pattern in W.ATTRIBUTIONS:
        text = F.regexp_replace(text, "(?iU)" + pattern, " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def on_subject(*texts: Column) -> Column:
    """Whether any subject word stands anywhere in the texts, also inside words."""
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(W.SUBJECT_WORDS))


def shown_tokens(text: Column) -> Column:
    """One token for each word on display: folded letters and digits, empty for marks alone."""
    return F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), reference_key)


def spoken_tokens(text: Column) -> Column:
    """Tokens as they are shown: a single letter joins the word after it."""
    none = F.array().cast("array<string>")

    def join(done: Column, token: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, token)))
        return F.when((F.size(done) > 0) & (F.length(last) == 1), joined).otherwise(F.concat(done, F.array(token)))

    return F.aggregate(F.filter(shown_tokens(text), lambda t: t != ""), none, join)


def words_match(spoken: Column, shown: Column) -> Column:
    """Equal words, or words of four letters or more with the same first four."""
    return (spoken == shown) | ((F.length(spoken) >= 4) & (F.length(shown) >= 4) & (F.substring(spoken, 1, 4) == F.substring(shown, 1, 4)))


MARK_STOP = ("dans", "pour", "avec", "cette", "celui", "ceux", "mais", "donc", "nous", "vous", "sont", "sera", "avez", "était", "alors", "leurs")


def highlighted(text: Column, transcript: Column) -> Column:
    """(word, hit) for each word of a text: hits are words of three letters or more that the transcript has."""
    clean = lambda t: F.regexp_replace(fold(t), r"[^A-Za-z0-9_\s]", "")
    said = F.filter(F.split(clean(transcript), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*MARK_STOP))
    shown = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return bound(said, lambda s: F.transform(shown, lambda t: F.struct(t.alias("word"), ((F.length(clean(t)) > 2) & F.array_contains(s, clean(t))).alias("hit"))))


def reading(shown: Column, said: Column) -> Column:
    """(ratio, tail) for arrays of words: the share of the shown words that are among the last 60 said, and whether at
    least four of the last five are (all, where there are fewer). Null for under four words."""

    def measure(s: Column) -> Column:
        covered = F.size(F.filter(shown, lambda w: F.array_contains(s, w)))
        tail = F.slice(shown, F.greatest(F.size(shown) - 4, F.lit(1)), 5)
        reached = F.size(F.filter(tail, lambda w: F.array_contains(s, w))) >= F.least(F.lit(4), F.size(tail))
        return F.when(F.size(shown) >= 4, F.struct((covered / F.size(shown)).alias("ratio"), reached.alias("tail")))

    return bound(F.slice(said, F.greatest(F.size(said) - 59, F.lit(1)), 60), measure)


def safe_end(text: Column, most: int) -> Column:
    """How many characters of a growing text are final: up to the last end of a sentence if text follows it; none if
    nothing does; without any end, up to the last space before `most` characters once there are more."""
    end = F.length(F.regexp_extract(text, r"(?s)^(.*[.!?…])", 1))
    follows = F.trim(F.substring(text, end + 1, F.length(text))) != ""
    space = F.length(F.regexp_extract(F.substring(text, 1, most), r"(?s)^(.*) [^ ]*$", 1))
    return F.when(end > 0, F.when(follows, end).otherwise(0)).when(F.length(text) > most, space).otherwise(0)


def new_words(before: Column, now: Column) -> Column:
    """The words of a transcript after the first words that it shares with the one before it."""
    a, b = (F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "") for t in (before, now))
    same = lambda a, b: F.zip_with(b, F.slice(a, 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = lambda b: F.aggregate(bound(a, lambda x: same(x, b)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return bound(b, lambda w: bound(common(w), lambda n: F.array_join(F.slice(w, n + 1, F.greatest(F.size(w), F.lit(1))), " ")))


def clock(value: Column) -> Column:
    """HH:mm of a time written 2026-07-28T10:14:05 or with a space, empty for anything else."""
    head = F.substring(value, 1, 19)
    time = F.coalesce(F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.date_format(time, "HH:mm"), F.lit(""))
