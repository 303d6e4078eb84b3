"""Text functions as Column expressions (T1-T13, T15, T17-T19). All return NULL-free results for NULL text unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = "ai bao các cái cho có của đang được gì hay hiện hỏi không là làm một nào những ra sao theo thế thì trong từ và về với".split()
#: Abbreviations with one meaning each, and what they stand for.
SYNONYMS = {
    "tkb": "thời khóa biểu", "ppct": "phân phối chương trình", "khbd": "kế hoạch bài dạy", "gdpt": "giáo dục phổ thông",
    "gdtx": "giáo dục thường xuyên", "gdnn": "giáo dục nghề nghiệp", "gdmn": "giáo dục mầm non", "thpt": "trung học phổ thông",
    "thcs": "trung học cơ sở", "bgddt": "bộ giáo dục đào tạo", "hs": "học sinh", "gv": "giáo viên", "sgk": "sách giáo khoa",
    "hk": "học kỳ", "cntt": "công nghệ thông tin", "nls": "năng lực số", "ai": "trí tuệ nhân tạo", "vtvl": "vị trí việc làm",
    "tt": "thông tư", "nd": "nghị định", "cv": "công văn",
}
#: Those that may be written out in place.
SAFE_ABBREVIATIONS = "gv hs thpt thcs gdpt gdtx gdnn gdmn sgk tkb ppct khbd cntt".split()
#: School levels 1 to 3, by name and with their abbreviations.
LEVEL_NAMES = ("tiểu học", "trung học cơ sở", "trung học phổ thông")
LEVEL_WORDS = ("tiểu học", "trung học cơ sở thcs", "trung học phổ thông thpt")
#: What table lines and formulas turn into when scanned.
OCR_JUNK = "‹›«»|¦·•■●¨´`\\"
#: Vietnamese function words without accents.
BARE_FUNCTION_WORDS = "cua cac duoc nhung viec nguoi hoc giao truong dinh nam thong theo nay voi doi trong va la co khong mot".split()
LEET_FROM, LEET_TO = "0134@!$", "oieaais"


def _folds() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their base letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    pairs += [("đ", "d"), ("Đ", "D")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()
VIETNAMESE_ACCENTED = "".join(sorted({c.lower() for c in FOLD_FROM if 0x1EA0 <= ord(c) < 0x1F00 or c in "àáãâèéêìíòóôõùúýăđĩũơư"}))


def _marks() -> list[tuple[str, str, str]]:
    """(mark, letters, letters with the mark) of combining marks, marks below first. A mark attaches to a letter right before it, so
    three rounds attach up to three marks in whatever order they stand."""
    of: dict[str, dict[str, str]] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        two = unicodedata.normalize("NFC", chr(code)), unicodedata.decomposition(chr(code)).split()
        if len(two[1]) == 2 and not two[1][0].startswith("<") and two[0] == chr(code):
            base, mark = (chr(int(x, 16)) for x in two[1])
            of.setdefault(mark, {})[base] = chr(code)
            bare, *rest = unicodedata.normalize("NFD", chr(code))
            above = unicodedata.normalize("NFC", bare + mark)
            if len(rest) == 2 and len(above) == 1 and unicodedata.combining(rest[0]) < unicodedata.combining(mark):
                of.setdefault(rest[0], {})[above] = chr(code)  # the mark below came after the one above
    order = sorted(of, key=lambda m: (unicodedata.combining(m), m)) * 3
    return [(m, "".join(of[m]), "".join(of[m].values())) for m in order]


MARKS = _marks()


def composed(text) -> Column:
    """Letters followed by combining marks as single letters (NFC for Latin letters); texts without marks come through untouched."""

    def attach(t: Column, m: Column) -> Column:
        mark, half = F.substring(m, 1, 1), F.call_function("div", F.char_length(m) - 1, F.lit(2)).cast("int")

        def one(p: Column, i: Column, n: Column) -> Column:
            last = F.right(p, F.lit(1))
            new = F.call_function("translate", last, F.substring(m, F.lit(2), half), F.substring(m, half + 2, half))
            return F.when(i == n - 1, p).when(new != last, F.concat(F.substring(p, F.lit(1), F.char_length(p) - 1), new)).otherwise(F.concat(p, mark))

        pieces = F.split(t, mark)
        return F.when(F.contains(t, mark), F.array_join(F.transform(pieces, lambda p, i: one(p, i, F.size(pieces))), "")).otherwise(t)

    table = F.split(F.lit("\n".join("".join(m) for m in MARKS)), "\n")  # one literal: a mark, its letters, those with the mark
    return F.when(_text(text).rlike(r"\p{Mn}"), F.aggregate(table, _text(text), attach)).otherwise(_text(text))


def _text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def raw_tokens(text) -> Column:
    return _runs(composed(text))


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"), F.lit(0))


def tokens(text) -> Column:
    """Lower-case runs of letters and digits of two characters or more that are no stop words."""
    return _meaningful(raw_tokens(text))


def _meaningful(words: Column) -> Column:
    return F.filter(words, lambda w: (F.char_length(w) > 1) & ~w.isin(STOP_WORDS))


def fold_accents(text) -> Column:
    """Letters without their marks, composed or not."""
    return F.regexp_replace(F.translate(_text(text), FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")


def split_camel_num(text) -> Column:
    """A blank between a small and a capital letter and between letters and digits."""
    out = F.regexp_replace(_text(text), r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.regexp_replace(out, r"(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})", " ")


def tokens_expanded(text) -> Column:
    """T4: T1 of T3, then each folded form that differs from its token and is not there yet, once."""

    def with_folds(t: Column) -> Column:
        accented = F.filter(t, lambda w: F.octet_length(w) > F.char_length(w))  # words of ASCII fold to themselves
        return F.concat(t, F.array_except(F.transform(accented, lambda w: F.translate(w, FOLD_FROM, FOLD_TO)), t))

    # composed first: what stands inside composed() is looked at twice
    return F.transform(F.array(_meaningful(_runs(split_camel_num(composed(text))))), with_folds)[0]


def _with_words(tokens: Column, asked: Column, words: list[str]) -> Column:
    return F.transform(F.array(tokens), lambda t: F.when(asked, F.concat(t, F.array_except(F.lit(words), t))).otherwise(t))[0]


def expand_query(text) -> Column:
    """T5: T4 plus synonyms per token with repeats, the abbreviation whose words all occur, level words and the capital AI."""
    phrases = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.lit(v.split()))])
    known = F.lit(list(SYNONYMS))

    def with_synonyms(own: Column) -> Column:
        return F.concat(own, F.flatten(F.transform(F.filter(own, lambda w: F.array_contains(known, w)), lambda w: phrases[w])))

    def with_short_forms(own: Column) -> Column:
        more = lambda out: F.filter(F.array(*[F.when((F.size(F.array_intersect(F.lit(p.split()), own)) == len(set(p.split()))) & ~F.array_contains(out, k), k) for k, p in SYNONYMS.items()]), lambda k: k.isNotNull())
        return F.transform(F.array(with_synonyms(own)), lambda out: F.concat(out, more(out)))[0]

    out = F.transform(F.array(tokens_expanded(text)), with_short_forms)[0]
    for k, words in enumerate(LEVEL_WORDS):
        asked = F.lower(_text(text)).rlike(rf"\bcấp\s+({k + 1}|i{{{k + 1}}})\b")
        out = _with_words(out, asked, words.split())
    return F.when(_text(text).rlike(r"\bAI\b"), F.concat(out, F.lit("ai trí tuệ nhân tạo".split()))).otherwise(out)


def spell_out(text) -> Column:
    """T6."""
    out = _text(text)
    for short in SAFE_ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?iU)\b{short}\b", SYNONYMS[short])
    for k, name in enumerate(LEVEL_NAMES):
        mark = rf"(?iU)\bcấp\s+({k + 1}|i{{{k + 1}}})\b"
        out = F.when(F.contains(F.lower(out), F.lit(name)), F.regexp_replace(out, mark, "")).otherwise(F.regexp_replace(out, mark, name))
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def compact(text) -> Column:
    """Folded, lower, without white space."""
    return F.regexp_replace(F.lower(fold_accents(text)), r"\s+", "")


def compact_positions(text) -> Column:
    """For every character of compact() its place (from 0) in the text."""
    n = F.char_length(_text(text))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.substring(_text(text), i + 1, F.lit(1)).rlike(r"^\s$"))


def clean_ocr(text) -> Column:
    """Junk becomes blanks, blanks are squeezed, line ends trimmed; lines stay."""
    out = F.translate(_text(text), OCR_JUNK, " " * len(OCR_JUNK))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"(?m)[ \t]+$", "")


def lost_accents(text) -> Column:
    """300 letters or more, under 3 % of them accented, over 8 % of Latin words function words."""
    low = F.lower(_text(text))
    letters = F.char_length(F.regexp_replace(low, r"[^\p{L}]", ""))
    accented = F.char_length(F.regexp_replace(low, f"[^{VIETNAMESE_ACCENTED}]", ""))
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    bare = F.size(F.filter(words, lambda w: F.array_contains(F.lit(BARE_FUNCTION_WORDS), w)))
    return F.coalesce((letters >= 300) & (accented / letters < 0.03) & (F.size(words) > 0) & (F.try_divide(bare, F.size(words)) > 0.08), F.lit(False))


def parse_vn_number(text) -> Column:
    """Comma for decimals, dots for thousands; a lone dot before other than three digits is a decimal point. NULL if no number."""
    t = F.trim(_text(text))
    plain = F.when(F.contains(t, F.lit(",")), F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")).when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return plain.try_cast("double")


def canonical_number(text) -> Column:
    """Separators go unless one comma is followed by one or two decimals at the end."""
    t = _text(text)
    return F.when(t.rlike(r"^[\d.]*\d,\d{1,2}$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(F.translate(t, ".,", ""))


def format_vn_number(number) -> Column:
    """Dots for thousands, a comma, six decimals at most, no trailing zeros."""
    s = F.format_number(F.round(number, 6), 6)
    s = F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")
    return F.translate(s, ",.", ".,")


_LETTER = r"[\p{L}\p{M}]"


def plain_evasion(text) -> Column:
    """Lower, format characters out, look-alike digits between letters read as letters, other signs to blanks."""
    t = F.regexp_replace(F.lower(_text(text)), r"\p{Cf}", "")
    for a, b in zip(LEET_FROM, LEET_TO, strict=True):
        t = F.regexp_replace(t, rf"(?<={_LETTER})[{a}](?=[0134@!$]*{_LETTER})|(?<={_LETTER}[oieas])[{a}](?=[0134@!$]*{_LETTER})", b)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}*]+", " "))


def evasion_variants(text) -> Column:
    """The normal form; lone letters joined; then repeats cut to two and to one."""
    base = plain_evasion(text)
    joined = F.regexp_replace(base, rf"(?<=(^|\s){_LETTER}) (?={_LETTER}(\s|$))", "")
    return F.array(base, joined, F.regexp_replace(joined, r"([\p{L}\p{N}])\1{2,}", "$1$1"), F.regexp_replace(joined, r"([\p{L}\p{N}])\1+", "$1"))


def masked_accents(variant) -> Column:
    """Words with accents become #, so that only what was typed without them is compared."""
    return F.array_join(F.transform(F.split(variant, " "), lambda w: F.when(F.translate(w, FOLD_FROM, FOLD_TO) == w, w).otherwise(F.lit("#"))), " ")


def content_hash(content) -> Column:
    """SHA-256, hex."""
    return F.sha2(content, 256)


def chunk_key(*parts) -> Column:
    """SHA-1 over the parts with a unit separator."""
    return F.sha1(F.concat_ws("\x1f", *[_text(p) for p in parts]))


def readable_title(name, min_length: int = 12, min_words: int = 3) -> Column:
    """Underscores to blanks, a trailing hash cut; NULL if too short or with fewer than three accented letters."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(name), r"\.[A-Za-z0-9]{1,5}$", ""), r"[_\-]?[0-9a-f]{8,}$", ""), r"[_\s]+", " "))
    accented = F.char_length(t) - F.char_length(F.regexp_replace(F.lower(t), f"[{VIETNAMESE_ACCENTED}]", ""))
    return F.when((F.char_length(t) >= min_length) & (F.size(F.split(t, " ")) >= min_words) & (accented >= 3), t)


def first_url(text) -> Column:
    """The first http(s) address, without trailing punctuation; NULL if none."""
    u = F.regexp_extract(_text(text), r"https?://[^\s<>\"']+", 0)
    return F.when(u != "", F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""))


def short_title(text, most: int = 80) -> Column:
    """T19."""
    t = F.trim(F.regexp_replace(_text(text), r"\s+", " "))
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))
