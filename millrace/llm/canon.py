"""Problem 1: one written form for texts that look the same.

A compiled transducer reads a text once, grapheme cluster by grapheme cluster. A precomputed, conflict-checked mapping has
single characters and sequences as keys (widths, ligatures and other make-ups of a letter, a letter followed by its marks
in any form between decomposed and composed, blanks, invisible characters); at each place of a cluster the longest key is
taken. Clusters that are letters wait in a word buffer until the word ends; then its look-alike letters are written in one
script and the word goes out.

Look-alikes are classes of letters of several scripts. A word is written in the first script that has a member of every
class in it (a letter of no class is a class of its own); where no script has, each look-alike becomes the first letter of
its class. As this depends on the classes of the word's letters alone, words that look the same come out equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.operators.pairs import keyed_pairs
from millrace.session import cut, spread

from .words import JAVA_WORD

# Letters that look alike, the first one stands for all (Latin, Greek, Cyrillic, Armenian, Cherokee, Lisu).
ALIKE = """
AΑАᎪꓮ BΒВᏴꓐ CСϹᏟꓚ DᎠꓓ EΕЕᎬꓰ FϜꓝ GԌᏀꓖ HΗНᎻꓧ IΙІӀꓲ JЈͿᎫꓙ KΚКᏦꓗ LᏞꓡ MΜМϺᎷꓟ NΝꓠ OΟОՕꓳ PΡРᏢꓑ QԚ RᏒꓣ SЅՏᏚꓢ TΤТᎢꓔ UՍꓴ VѴᏙꓦ WԜᏔꓪ XΧХꓫ YΥҮᎩꓬ ZΖᏃꓜ
aаαɑ cсϲ dԁ eе gɡց hһհ iі jјϳ lӏ nո oоοօ pрρ qԛ sѕ uυսʋ vνѵ wԝѡա xх yуү
ГΓ ПΠ ФΦ кκ пπ
""".split()
#: The script of a word that could be in several.
PREFERRED = ("LATIN", "CYRILLIC", "GREEK")
# How a character may be made up without looking different (tags of Unicode's compatibility mappings).
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
# Invisible characters besides the format characters (Cf): variation selectors, joiners, fillers.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))
BLANK_CONTROLS = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
# Conjoining jamo (first letters, vowels, last letters) and the syllables made of them.
JAMO_L, JAMO_V, JAMO_T, SYLLABLE = 0x1100, 0x1161, 0x11A7, 0xAC00


def build_mapping(looks: str = "".join(ALIKE)) -> dict[str, str]:
    """Key -> form: single characters whose form is another one, and sequences of a letter and its marks.

    Letters of ``looks`` are not made up of others, whatever the compatibility mappings say.
    """
    mapping: dict[str, str] = dict.fromkeys(BLANK_CONTROLS, " ")
    for code in range(0x80, 0x30000):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Cs", "Co") or char in looks or SYLLABLE <= code < SYLLABLE + 11172:
            continue
        if kind == "Cf" or char in INVISIBLE:
            mapping[char] = ""
        elif kind in ("Zs", "Zl", "Zp") or char == "\x85":
            mapping[char] = " "
        elif made_of := unicodedata.decomposition(char):
            if made_of[0] != "<":
                form = unicodedata.normalize("NFC", char)
                if form != char:
                    mapping[char] = form
                elif len(parts := [chr(int(c, 16)) for c in made_of.split()]) == 2:
                    mapping["".join(parts)] = char
                    mapping[unicodedata.normalize("NFD", char)] = char
            elif made_of.split(" ")[0] in SAME_LOOK_TAGS:
                form = unicodedata.normalize("NFKC", char)
                if form != char and not (form.startswith(" ") and len(form) > 1):
                    mapping[char] = form
    return {key: "".join(mapping.get(c, c) for c in form) for key, form in mapping.items()}


@lru_cache(maxsize=200_000)
def script(char: str) -> str:
    """The script of a letter, from its name ('' for one without)."""
    return unicodedata.name(char, "").split(" ", 1)[0]


def build_looks(alike: list[str]) -> tuple[dict[str, int], list[dict[str, str]]]:
    """Letter -> class, and for each class script -> its letter ('' -> the first one)."""
    classes: dict[str, int] = {}
    members: list[dict[str, str]] = []
    for letters in alike:
        own: dict[str, str] = {"": letters[0]}
        for char in letters:
            if char in classes:
                raise ValueError(f"conflict: {char!r} is in two classes of look-alikes")
            classes[char] = len(members)
            own.setdefault(script(char), char)
        members.append(own)
    return classes, members


def check_mapping(mapping: dict[str, str], looks: dict[str, int]) -> None:
    """No form may be rewritten again, however it is read, and a look-alike letter is nothing else's make-up."""
    for key, form in mapping.items():
        again = "".join(mapping.get(c, c) for c in form)
        if again != form:
            raise ValueError(f"conflict: {key!r} -> {form!r} -> {again!r}")
        if len(key) > 2 and fold(key[0], key[1:], mapping) not in (form, key):
            raise ValueError(f"conflict: {key!r} -> {form!r} or {fold(key[0], key[1:], mapping)!r}")
    for char in looks:
        if char in mapping:
            raise ValueError(f"conflict: look-alike {char!r} -> {mapping[char]!r}")


def fold(base: str, marks: str, mapping: dict[str, str]) -> str:
    """A letter with its marks taken in one after the other; marks that it has no form with stay, in their order.

    A mark is out of reach behind one of the same combining class that stayed.
    """
    left, classes = "", set()
    for mark in marks:
        kind = unicodedata.combining(mark)
        whole = mapping.get(base + mark) if kind not in classes else None
        if whole is None:
            left += mark
            classes.add(kind)
        else:
            base = whole
    return base + left


CLASS_OF, MEMBERS = build_looks(ALIKE)
MAPPING = build_mapping()
check_mapping(MAPPING, CLASS_OF)
LONGEST = max(map(len, MAPPING))
#: Letter -> (letter, marks) of letters with marks of their own.
APART = {c: (d[0], d[1:]) for c in set(MAPPING.values()) if len(c) == 1 and len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.category(d[0])[0] == "L"}

#: The longest stretch around characters beyond ASCII: a run of them with the ASCII letters and digits they touch.
UNIT = re.compile(r"(?:(?<![A-Za-z0-9])[A-Za-z0-9]++|[<=>])?[^\x00-\x7f]++(?:(?:[A-Za-z0-9]++|[<=>])[^\x00-\x7f]++)*[A-Za-z0-9]*+")
CLUSTER = regex.compile(r"\X")
JOINED = regex.compile(r"\p{Extended_Pictographic}[\p{EMod}\ufe0f]*(?:\u200d\p{Extended_Pictographic}[\p{EMod}\ufe0f]*)+")
CONTROLS = re.compile(f"[{BLANK_CONTROLS}]")


def _syllables(text: str) -> str:
    """Conjoining jamo as the syllables they make up."""
    out: list[str] = []
    for char in text:
        code, last = ord(char), ord(out[-1]) if out else 0
        if 0 <= code - JAMO_V < 21 and 0 <= last - JAMO_L < 19:
            out[-1] = chr(SYLLABLE + ((last - JAMO_L) * 21 + code - JAMO_V) * 28)
        elif 0 < code - JAMO_T < 28 and 0 <= last - SYLLABLE < 11172 and (last - SYLLABLE) % 28 == 0:
            out[-1] = chr(last + code - JAMO_T)
        else:
            out.append(char)
    return "".join(out)


@lru_cache(maxsize=200_000)
def _cluster(cluster: str) -> tuple[tuple[str, str], ...]:
    """What the transducer emits for a cluster: (letter or other character, marks) one after the other.

    Marks without a letter before them in the cluster come out with the letter ''.
    """
    if len(cluster) > 1 and JOINED.fullmatch(cluster):
        return ((cluster.replace("\ufe0f", ""), ""),)
    if any(0x1100 <= ord(c) < 0x1200 for c in cluster):
        cluster = _syllables(cluster)
    out: list[tuple[str, str]] = []
    at = 0
    while at < len(cluster):
        size = next((n for n in range(min(LONGEST, len(cluster) - at), 0, -1) if cluster[at : at + n] in MAPPING), 0)
        form = MAPPING[cluster[at : at + size]] if size else cluster[at]
        at += size or 1
        for char in form:
            letter, marks = APART.get(char, (char, ""))
            if unicodedata.combining(letter) or unicodedata.category(letter) == "Mn":
                out[-1:] = [(out[-1][0], out[-1][1] + letter + marks)] if out else [("", letter + marks)]
            else:
                out.append((letter, marks))
    return tuple(out)


@lru_cache(maxsize=100_000)
def _dressed(letter: str, marks: str) -> str:
    return fold(letter, "".join(sorted(marks, key=unicodedata.combining)), MAPPING) if len(marks) > 1 else MAPPING.get(letter + marks, letter + marks) if marks else letter


_is_letter = lru_cache(maxsize=200_000)(lambda char: char.isalpha())


@lru_cache(maxsize=100_000)
def _scripts(letter: str) -> frozenset[str]:
    """The scripts that have a letter that looks like this one."""
    return frozenset(MEMBERS[CLASS_OF[letter]].keys() - {""}) if letter in CLASS_OF else frozenset((script(letter),))


def _chosen(letters: set[str]) -> str:
    common = frozenset.intersection(*map(_scripts, letters))
    return next((s for s in PREFERRED if s in common), min(common, default=""))


def _word(word: list[tuple[str, str]]) -> str:
    """A finished word: its look-alikes in one script."""
    return _known_word(tuple(word)) if len(word) <= 16 else _written(word)


def _written(word: list[tuple[str, str]] | tuple[tuple[str, str], ...]) -> str:
    letters = {c for c, _ in word}
    if not letters.isdisjoint(CLASS_OF) and not all(c.isascii() or script(c) == "LATIN" and c not in CLASS_OF for c in letters):
        chosen = _chosen(letters)
        word = [(own.get(chosen, own[""]), m) if (own := MEMBERS[CLASS_OF[c]] if c in CLASS_OF else None) else (c, m) for c, m in word]
    return "".join([_dressed(c, m) if m else c for c, m in word])


_known_word = lru_cache(maxsize=200_000)(_written)


def _rewrite(unit: str) -> str:
    """One pass over the clusters of a unit."""
    out: list[str] = []
    word: list[tuple[str, str]] = []
    for cluster in CLUSTER.findall(unit):
        for letter, marks in _cluster(cluster):
            if not letter:  # marks cut off from their letter by something invisible
                if word:
                    word[-1] = (word[-1][0], word[-1][1] + marks)
                else:
                    out.append(marks)
            elif _is_letter(letter):
                word.append((letter, marks))
            else:
                if word:
                    out.append(_word(word))
                    word = []
                out.append(_dressed(letter, marks))
    if word:
        out.append(_word(word))
    return "".join(out)


_remembered = lru_cache(maxsize=50_000)(_rewrite)


def _unit(match: re.Match) -> str:
    unit = match.group()
    return _remembered(unit) if len(unit) <= 32 else _rewrite(unit)


@lru_cache(maxsize=100_000)
def _stretch(part: str) -> str:
    return UNIT.sub(_unit, part)


def canonical(text: str) -> str:
    """The one form of ``text``. Idempotent. Letter case, accents, punctuation and the number of blanks are kept."""
    if not text.isascii():
        # no unit reaches over a plain blank, and most stretches between blanks are ASCII or come again
        text = " ".join([part if part.isascii() else _stretch(part) if len(part) <= 32 else UNIT.sub(_unit, part) for part in text.split(" ")])
    return text if text.isprintable() else CONTROLS.sub(" ", text)


@F.pandas_udf(StringType())
def canonical_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: canonical(t) if isinstance(t, str) else None)


#: Declared nondeterministic so that a filter on the form does not make the planner compute it twice.
_once = canonical_udf.asNondeterministic()


def canonical_form(text: Column) -> Column:
    """The one form as a column; null for null, empty for empty."""
    return _once(text)


def with_form(samples: DataFrame) -> DataFrame:
    """line_no, text and form of each sample with a text. Extra columns are ignored; repeated rows stay."""
    return spread(samples.select("line_no", "text").where("text is not null")).withColumn("form", canonical_form(F.col("text")))


def look_alike_classes(samples: DataFrame) -> DataFrame:
    """line_no, key (of the form) and variant (of the text as written), for texts with words.

    Null texts and texts without words (after rewriting) are in no class.
    """
    return with_form(samples).where(F.col("form").rlike(JAVA_WORD)).select(
        "line_no", F.unhex(F.md5("form")).alias("key"), F.unhex(F.md5("text")).alias("variant")
    )


def look_alike_pairs(samples: DataFrame) -> DataFrame:
    """p1_found: pairs of line numbers whose texts look the same and differ in their characters.

    Classes with a single spelling are dropped by an aggregate before any pairing, however many copies they have.
    """
    rows = cut(look_alike_classes(samples).where("line_no is not null"))
    mixed = rows.groupBy("key").agg(F.min("variant").alias("lo"), F.max("variant").alias("hi")).where("lo <> hi").select("key")
    pairs = keyed_pairs(rows.join(mixed, "key", "left_semi"), ["key"], "line_no", ["line_no", "variant"])
    return pairs.where("a.variant <> b.variant").select(F.col("a.line_no").alias("line_no_a"), F.col("b.line_no").alias("line_no_b")).distinct()


def canonical_report(samples: DataFrame) -> DataFrame:
    """One row a sample: its form, and the size of its look-alike class and the class's smallest line number."""
    rows = with_form(samples).withColumn("key", F.unhex(F.md5("form")))
    sizes = rows.groupBy("key").agg(F.min("line_no").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return rows.join(sizes, "key").select("line_no", "form", (F.col("form") != F.col("text")).alias("changed"), "class_id", "class_rows")
