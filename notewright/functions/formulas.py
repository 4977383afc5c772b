"""Variables that a note declares in formulas, and plain letters that become formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.lines import INLINE_CODE, inside, let, lines_of, map_lines, only_if, protected_ranges
from notewright.functions.spacing import HAN

_FORMULA = r"\$\$([^$]+)\$\$|\$([^$\n]+)\$"
#: Greek letters and marks with their commands.
SYMBOLS = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Υ": "Upsilon", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega", "×": "times", "÷": "div", "±": "pm", "∓": "mp", "·": "cdot", "⋅": "cdot", "∈": "in", "∉": "notin", "∋": "ni", "≤": "le", "≥": "ge", "≠": "ne", "≈": "approx", "≡": "equiv", "⊂": "subset", "⊆": "subseteq", "⊃": "supset", "⊇": "supseteq", "∪": "cup", "∩": "cap", "∧": "land", "∨": "lor", "→": "to", "←": "leftarrow", "↔": "leftrightarrow", "⇒": "Rightarrow", "⇔": "Leftrightarrow", "∞": "infty", "∑": "sum", "∏": "prod", "∫": "int"}


def _one_of(marks: str) -> str:
    """A pattern of one of ``marks``. Java tries the parts of a long class one by one, so most characters fail at a few ranges before."""
    far = sorted(c for c in marks if ord(c) > 255)
    return f"[{''.join(c for c in marks if ord(c) <= 255)}{far[0]}-{far[-1]}&&[{marks}]]"


_MARK = _one_of("".join(SYMBOLS))


def _open_text(text: Column) -> Column:
    """The text without protected lines and inline code."""
    kept = let(lambda v: let(lambda w: F.transform(w["lines"], lambda x, i: F.when(inside(w["kept"], i), "").otherwise(x)), lines=v["lines"], kept=protected_ranges(v["lines"])), lines=lines_of(text))
    return F.regexp_replace(F.array_join(kept, "\n"), INLINE_CODE, "")


def declared(text: Column) -> Column:
    """Letters in the formulas of a text, sorted; commands and the arguments of text styles do not count."""
    open_ = _open_text(text)
    formulas = F.regexp_extract_all(open_, F.lit(f"({_FORMULA})"), F.lit(1))
    bare = F.transform(formulas, lambda f: F.regexp_replace(F.regexp_replace(f, r"\\(?:text|mathrm|operatorname|textbf|textit)\s*\{[^}]*\}", " "), r"\\[A-Za-z]+", " "))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(bare, lambda f: F.regexp_extract_all(f, F.lit("([A-Za-z])"), F.lit(1))))))


def variable_table(notes: DataFrame) -> DataFrame:
    """(note_id, letter) of every variable that a note's formulas hold."""
    return notes.where(F.col("text").contains("$")).select("note_id", F.explode(declared(F.col("text"))).alias("letter"))


_PIECE = rf"(`+[^`\n]*`+|!?\[\[[^\]\n]*\]\]|!?\[[^\]\n]*\]\([^)\n]*\)|[a-zA-Z][a-zA-Z0-9+.-]*://\S+|<[^<>\n]*>|%%[^\n]*?%%|\$\$[^$\n]*\$\$|\$[^$\n]*\$|《[^》\n]*》|“[^”\n]*”|[A-Za-z0-9_.]+|[ \t\u00a0]+|{HAN}+|.)"


def wrap_variables(text: Column, letters: Column) -> Column:
    """Single letters of ``letters`` next to Chinese text (blanks skipped) as formulas; not labels like ``(a)``."""

    def line(x: Column, letters: Column) -> Column:
        return let(lambda v: wrapped(v["t"], letters), t=F.regexp_extract_all(x, F.lit(_PIECE), F.lit(1)))

    def wrapped(t: Column, letters: Column) -> Column:
        blank = lambda c: c.rlike(r"^[ \t\u00a0]+$")

        def one(c: Column, i: Column) -> Column:
            before, after = F.get(t, i - 1), F.get(t, i + 1)
            before = F.when(blank(before), F.get(t, i - 2)).otherwise(before)
            after = F.when(blank(after), F.get(t, i + 2)).otherwise(after)
            near = F.coalesce(before.rlike(rf"(?:{HAN}|[）》”，。；：、])$"), F.lit(False)) | F.coalesce(after.rlike(rf"^{HAN}"), F.lit(False))
            label = F.coalesce((before == "(") & (after == ")"), F.lit(False))
            language = F.coalesce((after.startswith("语言")) & F.lit(True), F.lit(False))
            return F.when(c.rlike("^[A-Za-z]$") & F.array_contains(letters, c) & near & ~label & ~language, F.concat(F.lit("$"), c, F.lit("$"))).otherwise(c)

        return F.array_join(F.transform(t, one), "")

    return let(lambda v: F.when(F.size(v["letters"]) > 0, map_lines(v["t"], lambda x: F.when(x.rlike(HAN), line(x, v["letters"])).otherwise(x))).otherwise(v["t"]), t=text, letters=letters)


def wrap_declared(notes: DataFrame) -> DataFrame:
    """Notes with new_text: every declared variable that stands alone in Chinese prose wrapped. The table of letters
    belongs to the note, so it is computed in its row and nothing is shuffled."""
    return notes.withColumn("_letters", F.when(F.col("text").contains("$"), declared(F.col("text"))).otherwise(F.array().cast("array<string>"))).withColumn("new_text", wrap_variables(F.col("text"), F.col("_letters"))).drop("_letters")


def symbols_to_commands(text: Column) -> Column:
    """Greek letters and marks inside inline formulas as commands, and a lone Greek letter next to Chinese as a formula."""
    names = F.create_map(*[F.lit(v) for k, c in SYMBOLS.items() for v in (k, f"\\{c}")])
    greek = "".join(k for k in SYMBOLS if k.isalpha())

    def inner(f: Column) -> Column:
        t = F.regexp_extract_all(f, F.lit(r"([\s\S])"), F.lit(1))
        return F.array_join(let(lambda v: commands(v["t"]), t=t), "")

    def commands(t: Column) -> Column:
        return (F.transform(t, lambda c, i: F.when(c.rlike(_MARK), F.concat(F.try_element_at(names, c), F.when(F.coalesce(F.get(t, i + 1).rlike("[A-Za-z]"), F.lit(False)), " ").otherwise(""))).otherwise(c)))

    def line(x: Column) -> Column:
        lone = F.regexp_replace(x, rf"(?<={HAN})[ ]?([{greek}])(?![A-Za-z$\p{{IsGreek}}])|(?<![A-Za-z$\p{{IsGreek}}])([{greek}])[ ]?(?={HAN})", r"\$$1$2\$")
        t = F.regexp_extract_all(lone, F.lit(r"(`+[^`\n]*`+|\$\$[^$\n]*\$\$|\$[^$\n]*\$|[^$`]+|.)"), F.lit(1))
        return F.array_join(F.transform(t, lambda c: F.when(c.rlike(r"^\$.+\$$"), inner(c)).otherwise(c)), "")

    return only_if(lambda t: t.rlike(_MARK), lambda t: map_lines(t, lambda x: F.when(x.rlike(_MARK), line(x)).otherwise(x)), text)
