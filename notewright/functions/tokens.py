"""A line as an array of tokens: what kind each is, the language of its sentence, and what its symbol asks for.

Protected parts (code, links, addresses, tags, formulas, titles in quotes) are one token each, so that nothing looks inside
them. Kinds: C Chinese, L Latin word, W protected part that reads as a word, D number, M formula, F full-width mark,
T title in full-width quotes, Q text in double quotes, H half-width mark, O and P brackets, U unit, S other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.functions.lines import bound, first_of

#: One character that is set like Chinese.
HAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー０-９Ａ-Ｚａ-ｚ]"
LATIN = r"A-Za-zÀ-ɏ"
BLANK = r"[ \t ]"
#: Where an address ends: a blank, a bracket, or a mark that is no part of one.
_ADDRESS = r"[^\s<>()\[\]\p{IsHan}‐-⁯　-〿＀-￯]"
#: Kinds of protected spans. Where several begin at one place the first counts; what begins inside one is part of it.
PROTECTED = {
    "comment": r"%%[^\n]*?%%",
    "code": r"(?<!`)(?<tick>`+)(?!`)[^\n]*?(?<!`)\k<tick>(?!`)",
    "wikilink": r"!?\[\[[^\]\n]*\]\]",
    "footnote": r"\[\^[^\]\n]+\]",
    "link": r"!?\[[^\]\n]*\]\([^)\n]*\)",
    "url": rf"(?<![a-zA-Z])[a-zA-Z][a-zA-Z0-9+.-]*+://{_ADDRESS}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "host_port": r"(?<![A-Za-z])(?:[A-Za-z][A-Za-z0-9-]*+|\d{1,3}(?:\.\d{1,3}){3}):\d{1,5}(?!\d)",
    "domain": rf"(?<![A-Za-z0-9])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{{2,}}(?![A-Za-z0-9])(?::\d{{1,5}})?(?:/{_ADDRESS}*)?",
    "entity": r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);",
    "html": r"</?[A-Za-z][^<>\n]*>",
    "tag": r"(?<![^\s　])#[\p{L}\p{N}_][\p{L}\p{N}_\-/]*",
}
SPECIAL = "|".join(PROTECTED.values())
#: What every line with such a span holds; found faster than the spans.
HINT = r"[`\[@<&]|%%|:(?://|\d)|#[\p{L}\p{N}_]|[a-z0-9]\.[a-z]{2}"
MATH = r"\$\$[^$\n]+\$\$|\$(?![\s$])[^$\n]*(?<![\s\\])\$"

#: Marks of full width, by ranges of the character tables, and single ones beside them.
_FULL = r"、-〃〈-】〔-〜…‥—–·•“”‘’′″・！-／：-＠［-｀｛-～￥"
_OPENING, _CLOSING = "（【「『〔〖｛［《〈“‘", "）】」』〕〗｝］》〉”’"
#: Marks that stand between parts of an expression.
_SIGNS = "/\\=+<>*~^_#@%$&|→×÷±≤≥≠"
#: Units that may follow a number.
UNITS = ("km", "cm", "mm", "um", "μm", "nm", "m", "ml", "mL", "L", "ms", "us", "μs", "ns", "min", "h", "Hz", "kHz", "MHz", "GHz", "rpm", "kg", "mg", "ug", "μg", "g", "W", "kW", "MW", "V", "mV", "kV", "A", "mA", "Ω", "ohm", "Pa", "kPa", "MPa", "GPa", "N", "J", "kJ", "MJ", "cal", "kcal", "mol", "KB", "MB", "GB", "TB", "bit", "Byte", "px", "pt", "dpi", "ppi", "fps")
#: A number that a unit follows at once.
_COUNT = rf"\d+(?:[.,:]\d+)*(?=(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![{LATIN}0-9]))"
_WORD = rf"[{LATIN}0-9](?:[{LATIN}0-9]|['’_/-](?=[{LATIN}0-9])|(?<=\d)[.,:](?=\d))*"
_TITLE = r"《[^》\n]*(?:》|$)|〈[^〉\n]*(?:〉|$)|“[^”\n]*(?:”|$)|‘[^’\n]*(?:’|$)"
_MARKS = r"\.{2,}|\|{2,}|&{2,}|\*+|_+|=+|~+|°[CF]"
_QUOTE = r'"[^"\n]*"'


def _patterns(*first: str) -> tuple[str, str]:
    """What cuts a line into pieces, for lines that may hold a protected span and for others. Nothing else begins with a Chinese
    character or a blank, so these are looked for first."""
    pattern = lambda *special: "((?s:" + "|".join([rf"{HAN}+", rf"{BLANK}+", *first, *special, _TITLE, MATH, _WORD, _MARKS, "."]) + "))"
    return pattern(SPECIAL), pattern()


_PLAIN, _QUOTED, _COUNTED, _BOTH = _patterns(), _patterns(_QUOTE), _patterns(_COUNT), _patterns(_QUOTE, _COUNT)
_BLANKS = BLANK[1:-1].replace("\\t", "\t")


def _in(c: Column, marks: str) -> Column:
    return F.lit(marks).contains(c)


def is_kind(t: Column, kinds: str) -> Column:
    """Whether a token is of one of ``kinds``, a letter each."""
    return _in(t["k"], kinds)


def _from_to(t: Column, first: str, end: str) -> Column:
    """Whether a text begins with a character from ``first`` up to ``end``, which is left out."""
    return (t >= first) & (t < end)


#: Kinds of single ASCII characters.
_SINGLE = {" ": "B", "\t": "B", ",": "H", ".": "H", "!": "H", "?": "H", ":": "H", "(": "O", ")": "P"}


def kind_of(t: Column) -> Column:
    """The kind of a token, from its text. Most are told by their first character, without a pattern."""
    one = F.char_length(t) == 1
    named = (t.contains(".") | t.contains(":") | t.contains("@")) & t.rlike(r"://|@|\.[a-z]|^[A-Za-z][A-Za-z0-9-]*:")
    word = F.when(named, "W").otherwise("L")
    return first_of(
        (_from_to(t, "一", "鿰"), "C"),
        (_from_to(t, "a", "{") | _from_to(t, "A", "["), word),
        (_in(t, "".join(_SINGLE)) & one, F.translate(t, "".join(_SINGLE), "".join(_SINGLE.values()))),
        (_from_to(t, "0", ":"), F.when(t.rlike(r"^\d[\d.,:/_'’-]*$"), F.when(t.rlike(r"^\d+(?:\.\d+){3}:\d"), "W").otherwise("D")).otherwise(word)),
        (_in(_first(t), _BLANKS), "B"),
        (t.rlike(rf"^{HAN}"), "C"),
        (t.rlike(rf"^[{LATIN}]"), word),
        (t.rlike(r"^(?:[℃℉]|°[CF])$"), "U"),
        (~one & _in(_first(t), "《〈“‘"), "T"),
        (~one & t.startswith('"'), "Q"),
        (~one & t.rlike(r"^\$.+\$$"), "M"),
        (~one & t.rlike(r"^(?:[`!\[<%]|#|&[#A-Za-z])"), "W"),
        (one & t.rlike(f"^[{_FULL}]$"), "F"),
        otherwise="S",
    )


def is_wordlike(t: Column) -> Column:
    """Latin words, numbers and formulas: what a space may stand beside."""
    return is_kind(t, "LWDEM")


def _first(t: Column) -> Column:
    return F.substring(t, 1, 1)


def _last(t: Column) -> Column:
    return F.substring(t, -1, 1)


def _token(t: Column, /, **new: Column | str) -> Column:
    """A token with some of its parts anew: its text t, kind k, blanks g, wishes l and r, language z and emphasis e."""
    part = lambda c: new[c] if isinstance(new.get(c), Column) else F.lit(new[c]) if c in new else t[c]
    return F.struct(*[part(c).alias(c) for c in ("t", "k", "g", "l", "r", "z", "e")])


def _in_words(x: Column, t: Column, i: Column) -> Column:
    """Whether a number stands beside a Latin word, at most a blank or a dot, stroke or dash away: it is a part of it then."""

    def beside(at: Column, gap: Column, far: Column, far_gap: Column) -> Column:
        near = (at["k"] == "L") & gap.isin("", " ")
        joined = at["t"].isin(".", "_", "-", "/") & (gap == "") & (far["k"] == "L") & (far_gap == "")
        number = (at["k"] == "D") & gap.isin("", " ") & (far["k"] == "L") & far_gap.isin("", " ")
        return F.coalesce(near | joined | number, F.lit(False))

    before, after = F.get(x, i - 1), F.get(x, i + 1)
    return beside(before, t["g"], F.get(x, i - 2), before["g"]) | beside(after, after["g"], F.get(x, i + 2), F.get(x, i + 2)["g"])


def _asks(x: Column) -> Column:
    """Numbers in words become kind E. Adds l and r, what a symbol asks for on its left and right: none, space, latin (a space
    beside words only), keep, or nothing. A symbol beside anything but words is only mentioned and asks for none."""

    def one(t: Column, i: Column) -> Column:
        before, after = F.get(x, i - 1), F.get(x, i + 1)
        follows = after["g"] == ""
        single = lambda w: (w["k"] == "L") & (F.char_length(w["t"]) == 1)
        letters = F.coalesce(single(before) & single(after) & (t["g"] == "") & follows, F.lit(False))
        mentioned = F.coalesce(~is_wordlike(before), F.lit(False)) | F.coalesce(~is_wordlike(after), F.lit(False))
        notation = F.coalesce((t["g"] == "") & _last(before["t"]).rlike(r"[A-Za-z0-9_^{}\\̀-ͯ]"), F.lit(False)) | F.coalesce(follows & _first(after["t"]).rlike(r"[A-Za-z0-9_^{}\\̀-ͯ]"), F.lit(False))
        inner = F.regexp_replace(t["t"], rf'^"{BLANK}*|{BLANK}*"$', "")
        outside = lambda w, c: F.when(F.coalesce(~is_wordlike(w), F.lit(False)) | ~c.rlike(rf"[{LATIN}0-9$]"), "none").otherwise("latin")
        asks = lambda left, right, **kind: _token(t, **kind, l=left, r=right, e=F.lit(0))
        # A dot between single letters is no mark: e.g.
        return first_of(
            (t["k"] == "D", asks("", "", k=F.when(_in_words(x, t, i), "E").otherwise("D"))),
            (~is_kind(t, "HQS"), asks("", "")),
            ((t["k"] == "H") & (t["t"] == ".") & letters, asks("", "", k="S")),
            (t["k"] == "H", asks("none", "space")),
            (t["k"] == "Q", asks(outside(before, _first(inner)), outside(after, _last(inner)))),
            (t["t"].rlike(r"^\.{2,}$") | (t["t"] == "^"), asks("none", "none")),
            (t["t"] == "|", F.when(notation, asks("keep", "keep")).otherwise(asks("none", "none"))),
            (t["t"].startswith("|"), asks("keep", "keep")),
            (t["t"].startswith("&"), first_of((letters, asks("", "")), (mentioned, asks("none", "none")), otherwise=asks("latin", "latin"))),
            (t["t"] == "→", F.when(mentioned, asks("none", "none")).otherwise(asks("latin", "latin"))),
            otherwise=asks("", ""),
        )

    return F.transform(x, one)


def _sentences(x: Column) -> Column:
    """The sentences: where each begins, its number of tokens n and its language z: en without Chinese and with two Latin words
    or more (not letters only, as in f(x)), zh with as many Chinese characters as Latin words or more, else nothing. A sentence
    ends at 。！？；."""
    marks = F.filter(F.transform(x, lambda t, i: F.when((t["k"] == "F") & _in(t["t"], "。！？；"), i + 1)), lambda i: i.isNotNull())
    ends = F.array_distinct(F.concat(F.array(F.lit(0)), marks, F.array(F.size(x))))

    def language(own: Column) -> Column:
        times = lambda t, pattern: F.regexp_count(t["t"], F.lit(pattern))
        han = F.aggregate(own, F.lit(0), lambda n, t: first_of((t["k"] == "C", n + F.char_length(t["t"])), (is_kind(t, "TQ"), n + times(t, HAN)), otherwise=n))
        latin = F.aggregate(own, F.lit(0), lambda n, t: F.when(is_kind(t, "LTQ"), n + times(t, f"[{LATIN}]+")).otherwise(n))
        long = F.exists(own, lambda t: is_kind(t, "LTQ") & t["t"].rlike(f"[{LATIN}]{{2}}"))
        z = lambda n: first_of(((n["han"] == 0) & (n["latin"] >= 2) & long, "en"), ((n["han"] > 0) & (n["latin"] <= n["han"]), "zh"), otherwise="")
        return bound(z, han=han, latin=latin)

    def one(v: Column, first: Column, i: Column) -> Column:
        return bound(lambda w: F.struct(first.alias("first"), F.size(w["own"]).alias("n"), language(w["own"]).alias("z")), own=F.slice(v["x"], first + 1, F.get(v["ends"], i + 1) - first))

    cut = lambda v: F.transform(F.slice(v["ends"], 1, F.size(v["ends"]) - 1), lambda first, i: one(v, first, i))
    return bound(cut, x=x, ends=ends)


def _languages(x: Column) -> Column:
    """The tokens with z, the language of their sentence."""
    with_z = lambda own, p: F.transform(own, lambda t: F.struct(*[t[c].alias(c) for c in ("t", "k", "g")], p["z"].alias("z")))
    cut = lambda s: F.flatten(F.transform(s["parts"], lambda p: with_z(F.slice(s["x"], p["first"] + 1, p["n"]), p)))
    return bound(lambda s: F.when(F.size(s["parts"]) == 1, with_z(s["x"], F.get(s["parts"], F.lit(0)))).otherwise(cut(s)), x=x, parts=_sentences(x))


_WIDER = {",": "，", ":": "：", ";": "；", "!": "！", "?": "？"}
_NARROWER = {"，": ",", "。": ".", "、": ",", "；": ";", "！": "!", "？": "?"}


def _looked_up(t: Column, table: dict[str, str]) -> Column:
    return F.translate(t, "".join(table), "".join(table.values()))


def is_sign(t: Column) -> Column:
    """Marks and signs, beside which a mark keeps its width."""
    return F.coalesce(is_kind(t, "FTQH") | (t["l"] != "") | ((t["k"] == "S") & ((t["t"] == ";") | _in(_first(t["t"]), _SIGNS))), F.lit(False))


def _bracketed(x: Column) -> Column:
    """The ranges of tokens inside half-width brackets; one that is never closed runs to the end."""
    empty = F.array().cast("array<struct<first:int,last:int>>")
    marks = F.filter(F.transform(x, lambda t, i: F.struct(i.alias("i"), t["k"].alias("k"))), lambda m: is_kind(m, "OP"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("first"), empty.alias("ranges"))

    def step(s: Column, m: Column) -> Column:
        opens = m["k"] == "O"
        closed = ~opens & (s["depth"] == 1)
        ranges = F.when(closed, F.concat(s["ranges"], F.array(F.struct(s["first"].alias("first"), m["i"].alias("last"))))).otherwise(s["ranges"])
        return F.struct(F.when(opens, s["depth"] + 1).otherwise(F.greatest(s["depth"] - 1, F.lit(0))).alias("depth"), F.when(opens & (s["depth"] == 0), m["i"]).otherwise(s["first"]).alias("first"), ranges.alias("ranges"))

    return F.aggregate(marks, start, step, lambda s: F.when(s["depth"] > 0, F.concat(s["ranges"], F.array(F.struct(s["first"].alias("first"), F.size(x).alias("last"))))).otherwise(s["ranges"]))


def _widths(x: Column) -> Column:
    """Marks in the width of their sentence: full-width ones of an English sentence become half-width, unless they stand against
    Chinese; half-width ones become full-width after Chinese, before Chinese or in a Chinese sentence. A mark in half-width
    brackets, after a number or a backslash, or beside another mark or sign stays, and so does a colon before a number."""

    def one(t: Column, i: Column, s: Column) -> Column:
        before, after = F.get(s["x"], i - 1), F.get(s["x"], i + 1)
        touches = F.coalesce((before["k"] == "C") & (t["g"] == ""), F.lit(False)) | F.coalesce((after["k"] == "C") & (after["g"] == ""), F.lit(False))
        dots = (t["t"] == "…") & ~F.coalesce((before["t"] == "…") & (t["g"] == ""), F.lit(False)) & ~F.coalesce((after["t"] == "…") & (after["g"] == ""), F.lit(False))
        half = (t["k"] == "F") & (t["z"] == "en") & ~touches & (_in(t["t"], "".join(_NARROWER)) | dots)
        shut = F.exists(s["b"], lambda r: (r["first"] < i) & (i < r["last"]))
        after_number = (t["g"] == "") & is_kind(before, "DE") | (before["k"] == "L") & before["t"].rlike(r"\d$") & (t["g"] == "")
        fixed = F.coalesce(after_number, F.lit(False)) | (F.coalesce(before["t"] == "\\", F.lit(False)) & (t["g"] == ""))
        chinese = F.coalesce((before["k"] == "C") & (t["g"] == ""), F.lit(False)) | F.coalesce(after["k"] == "C", F.lit(False)) | (t["z"] == "zh")
        held = (is_sign(before) & (t["g"] == "")) | is_sign(after) | ((t["t"] == ":") & F.coalesce(is_kind(after, "DE"), F.lit(False)))
        full = (i > 0) & _in(t["t"], "".join(_WIDER)) & ~fixed & chinese & ~held & ~shut
        narrow = first_of((t["t"] == "…", _token(t, t="...", k="S", l="none", r="none")), (t["t"] == "；", _token(t, t=";", k="S", l="", r="")), otherwise=_token(t, t=_looked_up(t["t"], _NARROWER), k="H", l="none", r="space"))
        return first_of((half, narrow), (full, _token(t, t=_looked_up(t["t"], _WIDER), k="F", l="", r="")), otherwise=t)

    marked = F.exists(x, lambda t: _in(t["t"], "".join([*_WIDER, *_NARROWER, "…"])))
    return F.when(marked, bound(lambda s: F.transform(s["x"], lambda t, i: one(t, i, s)), x=x, b=_bracketed(x))).otherwise(x)


def _emphasis(x: Column) -> Column:
    """The places of marks of emphasis that open (first) and close (last). A mark opens before something and
    closes, if one of its own is open, after something."""
    kind = "array<struct<m:string,i:int>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast("array<int>").alias("first"), F.array().cast("array<int>").alias("last"))

    def step(s: Column, m: Column) -> Column:
        own = F.filter(s["open"], lambda o: o["m"] == m["m"])
        others = F.filter(s["open"], lambda o: o["m"] != m["m"])
        closed = F.struct(others.alias("open"), F.concat(s["first"], own["i"]).alias("first"), F.concat(s["last"], F.array(m["i"])).alias("last"))
        opened = F.struct(F.concat(others, F.array(F.struct(m["m"].alias("m"), m["i"].alias("i")))).alias("open"), s["first"].alias("first"), s["last"].alias("last"))
        return F.when((F.size(own) > 0) & m["tight"], closed).when(m["before"], opened).otherwise(s)

    mark = lambda t, i: F.when((t["k"] == "S") & t["t"].rlike(r"^(?:\*{1,3}|_{1,3}|==|~~)$"), F.struct(t["t"].alias("m"), i.alias("i"), ((i > 0) & (t["g"] == "")).alias("tight"), F.coalesce(F.get(x, i + 1)["g"] == "", F.lit(False)).alias("before")))
    marks = F.filter(F.transform(x, mark), lambda m: m.isNotNull())
    return bound(lambda v: F.when(F.size(v["marks"]) > 1, F.aggregate(v["marks"], start, step)), marks=marks)


def _emphasised(x: Column) -> Column:
    """The tokens with e: 1 for a mark of emphasis that opens, -1 for its closing one, else 0. Most lines hold no pair."""
    sign = lambda t, i, s: F.when(t["k"] != "S", 0).when(F.array_contains(s["pairs"]["first"], i), 1).when(F.array_contains(s["pairs"]["last"], i), -1).otherwise(0)
    return bound(lambda s: F.when(s["pairs"].isNull(), s["x"]).otherwise(F.transform(s["x"], lambda t, i: _token(t, e=sign(t, i, s)))), x=x, pairs=_emphasis(x))


def _raw(line: Column, count_units: bool) -> Column:
    """A line cut into pieces of text. Text in double quotes is one piece where their number is even."""
    even = F.regexp_count(F.regexp_replace(line, f"{SPECIAL}|{MATH}", ""), F.lit('"')) % 2 == 0
    single, quoted = (_COUNTED, _BOTH) if count_units else (_PLAIN, _QUOTED)
    cut = lambda p: F.regexp_extract_all(line, F.lit(p), F.lit(1))
    found = lambda p: F.when(line.rlike(HINT), cut(p[0])).otherwise(cut(p[1]))
    return F.when(line.contains('"') & even, found(quoted)).otherwise(found(single))


def _typed(raw: Column) -> Column:
    """Pieces with their kinds and the blanks before them; blanks at the edges inside quotes are dropped."""
    gap = lambda i: F.when((i > 0) & _in(_first(F.get(raw, i - 1)), _BLANKS), F.get(raw, i - 1)).otherwise("")
    quoted = lambda t: (_in(_first(t), '"《〈“‘') | _in(_last(t), '"》〉”’')) & t.rlike(rf'^["《〈“‘]{BLANK}|{BLANK}["》〉”’]$')
    tight = lambda t: F.when(quoted(t), F.regexp_replace(t, rf'(?<=^["《〈“‘]){BLANK}+|{BLANK}+(?=["》〉”’]$)', "")).otherwise(t)
    return F.filter(F.transform(raw, lambda t, i: F.when(~_in(_first(t), _BLANKS), F.struct(tight(t).alias("t"), kind_of(t).alias("k"), gap(i).alias("g")))), lambda t: t.isNotNull())


def token_steps(widths: bool = True, count_units: bool = False) -> list[Callable[[Column], Column]]:
    """The steps from a line to its tokens: text t, kind k, the blanks before it g, what it asks for on its left l and right r,
    the language of its sentence z, and whether it opens or closes an emphasis e. With ``widths``, marks have the width that
    their sentence asks for. Each step is meant for a projection of its own: nested, they take Spark minutes to resolve."""
    typed = lambda line: bound(lambda v: _typed(v["raw"]), raw=_raw(line, count_units))
    asked = lambda x: bound(lambda v: _widths(v["x"]), x=_asks(x)) if widths else _asks(x)
    return [typed, _languages, asked, _emphasised]
