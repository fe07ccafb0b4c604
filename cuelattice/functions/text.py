"""Column functions on cue texts: counts, scripts, tokens, notes, times. All stay in the JVM.

Regular expressions use classes that Java and RE2 read alike.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of scripts that are counted by character, since they put no spaces between words.
UNSPACED = (
    r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}\x{0e00}-\x{0eff}"
    r"\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{0900}-\x{0dff}]"
)
#: Scripts that subtitle checks tell apart.
SCRIPTS = {
    "latin": r"[A-Za-z\x{00c0}-\x{024f}]",
    "han": r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]",
    "kana": r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}]",
    "hangul": r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{ac00}-\x{d7af}]",
    "cyrillic": r"[\x{0400}-\x{04ff}]",
    "arabic": r"[\x{0600}-\x{06ff}]",
}
WORDY = r"[\p{L}\p{N}_]"
BLANK = r"[ \t\n\r\f\v]+"
#: Short utterances that recognisers invent over noise.
FILLERS = (
    "thank you", "thanks", "you", "the", "a", "an", "is", "it", "we", "um", "uh", "hmm", "ah", "oh", "like", "so", "well",
    "yeah", "okay", "ok", "right", "yes", "no", "and", "but", "or", "字幕", "字幕由", "感谢", "谢谢", "订阅", "观看",
)
#: What a model's private reasoning or answer format leaves in a text, without spaces and in lower case.
LEAKS = (
    "<think>", "</think>", "<analysis>", "</analysis>", "<reasoning>", "</reasoning>", "analysis:", "reasoning:",
    "```", "作为ai", "作为一个ai", "作为一名ai", "推理过程:", "推理过程：",
)
#: Whole notes that stand where a translation should, and words by which a note names the cue before
#: and says that it holds this one.
NOTES = (
    "sameasabove", "omitted", *[f"merged{how}{the}{where}" for how in ("", "with", "into") for the in ("", "the") for where in ("previous", "above")],
    "同上", "见上", "略", "省略", "无需翻译", "不单独翻译", "内容同上", "内容省略",
)
CUE_BEFORE = ("上一句", "上句", "上一条", "上条", "前一句", "前一条", "前文", "前面")
HELD_THERE = ("合并", "并入", "接上", "延续", "已译", "包含")
#: Punctuation around a note.
AROUND = "()（）[]【】<>《》“”\"'。，、；;：:！!?"
NUMBER = r"[0-9]+(?:[.,:/-][0-9]+)*%?"
IDENTIFIER = r"[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9]+)*|[A-Za-z]+-?[0-9][A-Za-z0-9-]*"


def pieces(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Characters of unspaced scripts, and words of the rest."""
    return F.coalesce(F.regexp_count(text, F.lit(UNSPACED)) + F.size(pieces(F.regexp_replace(text, UNSPACED, " "))), F.lit(0))


def reading_units(text: Column) -> Column:
    """As word_count, but words without a letter, digit or underscore don't count."""
    rest = F.filter(pieces(F.regexp_replace(text, UNSPACED, " ")), lambda w: w.rlike(WORDY))
    return F.coalesce(F.regexp_count(text, F.lit(UNSPACED)) + F.size(rest), F.lit(0))


def mainly_unspaced(text: Column, share: float = 0.5) -> Column:
    """Whether over ``share`` of the visible characters belong to unspaced scripts."""
    visible = F.length(F.regexp_replace(text, BLANK, ""))
    return F.coalesce((visible > 0) & (F.regexp_count(text, F.lit(UNSPACED)) > share * visible), F.lit(False))


def scripts(text: Column) -> Column:
    """Names of the scripts that occur, in the order of SCRIPTS."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SCRIPTS.items()]), lambda x: x.isNotNull())


def only_punctuation(text: Column) -> Column:
    return ~text.rlike(WORDY)


def is_filler(text: Column, duration_ms: Column) -> Column:
    """A short cue that says next to nothing: under half a second and under three letters, or a known filler."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"[.,!?。，！？]+$", "")
    return (duration_ms < 500) & ((F.length(bare) < 3) | bare.isin(*FILLERS))


def one_of(tests: Iterable[Column]) -> Column:
    """Whether any of the tests holds."""
    return reduce(or_, tests)


def has_leak(text: Column) -> Column:
    """Whether a text holds one of LEAKS, whatever its spaces and case."""
    bare = F.regexp_replace(F.lower(text), r"[ \t\r\n]+", "")
    return one_of(bare.contains(x) for x in LEAKS)


def is_note(text: Column) -> Column:
    """An empty text, one of NOTES, or a text that begins or ends with the cue before and at its other end says that it is held there."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", ""))
    bare = F.btrim(bare, F.lit(AROUND))
    begins, ends = (lambda xs: one_of(bare.startswith(x) for x in xs)), (lambda xs: one_of(bare.endswith(x) for x in xs))
    return (bare == "") | bare.isin(*NOTES) | (begins(HELD_THERE) & ends(CUE_BEFORE)) | (begins(CUE_BEFORE) & ends(HELD_THERE))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), 0)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def ends_sentence(text: Column) -> Column:
    """Ends in a sentence mark; an ellipsis isn't one."""
    trimmed = F.trim(text)
    return trimmed.rlike(r"[.!?。！？][\"'”’)\]]*$") & ~trimmed.rlike(r"(\.\.|…)[\"'”’)\]]*$")


def strip_markup(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"[ \t\r\n]+", " "))


def expected_word_ms(text: Column) -> Column:
    """How long a word of so many letters is expected to take at most."""
    n = F.length(F.regexp_replace(text, r"[^A-Za-z0-9\x{00c0}-\x{017f}]", ""))
    return F.when(n <= 2, 650).when(n <= 4, 900).otherwise(F.greatest(F.lit(900), F.least(F.lit(1800), n * 180 + 500)))


def clock(ms: Column, mark: str = ",") -> Column:
    """HH:MM:SS and three digits after ``mark``; times before zero are zero."""
    t = F.greatest(F.lit(0), ms.cast("long"))
    part = lambda size, n: F.lpad(F.floor(t / size) % n if n else F.floor(t / size), 2, "0")
    hours = F.floor(t / 3_600_000)
    whole = F.when(hours > 99, hours.cast("string")).otherwise(F.lpad(hours.cast("string"), 2, "0"))
    return F.concat(whole, F.lit(":"), part(60_000, 60).cast("string"), F.lit(":"), part(1000, 60).cast("string"), F.lit(mark), F.lpad((t % 1000).cast("string"), 3, "0"))


def ass_clock(ms: Column) -> Column:
    """H:MM:SS.cc, cut to hundredths."""
    t = F.greatest(F.lit(0), ms.cast("long"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.floor(t / 3_600_000).cast("string"), F.lit(":"), two(F.floor(t / 60_000) % 60), F.lit(":"), two(F.floor(t / 1000) % 60), F.lit("."), two(F.floor(t % 1000 / 10)))


def parse_clock(text: Column) -> Column:
    """Milliseconds of [HH:]MM:SS[.,]f...; null where it is no time."""
    pattern = r"^[ ]*(?:([0-9]+):)?([0-5]?[0-9]):([0-5]?[0-9])(?:[.,]([0-9]{1,3}))?[ ]*$"
    get = lambda i: F.regexp_extract(text, pattern, i)
    hours = F.when(get(1) == "", 0).otherwise(get(1).try_cast("long"))
    ms = F.when(get(4) == "", 0).otherwise(F.rpad(get(4), 3, "0").try_cast("long"))
    return F.when(text.rlike(pattern), (hours * 3600 + get(2).try_cast("long") * 60 + get(3).try_cast("long")) * 1000 + ms)


def language_code(code: Column) -> Column:
    """Two-letter code in lower case, without its region; the three-letter names of LANGUAGES by their two."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(code, F.lit("")))), "_", "-")
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, bare), F.substring_index(bare, "-", 1))


#: Languages whose three-letter names are known.
LANGUAGES = {"eng": "en", "jpn": "ja", "kor": "ko", "zho": "zh", "chi": "zh"}


def without_tail_marks(text: Column) -> Column:
    """A trimmed text without the Chinese commas and full stops at its end."""
    return F.regexp_replace(F.trim(text), "[，。]+$", "")


def spaced_marks(text: Column) -> Column:
    """A translated line with spaces for Chinese commas and full stops.

    In a line with a Han character also for Latin ones, but not between two ASCII letters or digits, where they
    belong to a number or a name.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[，。]", " ")
    latin = F.regexp_replace(plain, r"(?<![A-Za-z0-9])[,.]|[,.](?![A-Za-z0-9])", " ")
    spaced = F.when(text.rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"), latin).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "、+[ \t]*$", ""), "[ \t]{2,}", " "))


#: Words that leave a cue's end hanging.
DANGLING = (
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "of", "on", "or", "over", "that", "the", "these", "this", "those", "to", "under", "with",
)


def dangles(text: Column) -> Column:
    """Whether a text's last word leaves it hanging; a single capital letter does not."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), 0)
    return F.coalesce(F.element_at(F.when(F.size(words) > 0, words), -1).isin(*DANGLING) & ~F.trim(text).rlike("^[A-Z]$"), F.lit(False))


def is_word_level(text: Column) -> Column:
    """A single word, or one or two characters where scripts put no spaces."""
    bare = F.trim(text)
    return F.when(mainly_unspaced(bare), F.length(bare) <= 2).otherwise(F.size(pieces(bare)) == 1)


def source_copy(output: Column, source: Column) -> Column:
    """Whether an output of four letters or more has just the source's letters and digits."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z\x{3400}-\x{9fff}]+", "")
    return (F.length(bare(output)) >= 4) & (bare(output) == bare(source))


#: Scripts that a text in a language has to show.
REQUIRED = {
    "zh": r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]",
    "ja": r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]",
    "ko": r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{ac00}-\x{d7af}]",
}
NAME_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789-"


def is_address(text: Column) -> Column:
    """Whether a text is just a web address: a name with a dot or more, then a path, which may have spaces around its slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[ \t]*/[ \t]*", "/"), "^https?://|[.!?]$", "")
    steps = F.split(bare, "/")
    only = lambda x, letters: (x != "") & (F.translate(x, letters, "") == "")
    name = F.split(steps[0], r"\.")
    path = F.slice(steps, F.lit(2), F.size(steps) - 1)
    return (F.size(name) > 1) & F.forall(name, lambda x: only(x, NAME_LETTERS)) & F.forall(path, lambda x: only(x, NAME_LETTERS + "_"))


def is_untranslated(output: Column, source: Column, target: str) -> Column:
    """Whether an output lacks the script of ``target`` although its source has words; a bare address needs none."""
    return ~F.coalesce(output, F.lit("")).rlike(REQUIRED[target]) & source.rlike(r"\p{L}") & ~is_address(source)
