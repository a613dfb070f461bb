"""Classification of source text by banks of named signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# What is taken out of a text before it is searched, in this order.
STRINGS = r"\"(?:\\.|[^\"\\])*\""
CHARS = r"'(?:\\.|[^'\\])*'"
BLOCK_COMMENTS = r"(?s)/\*.*?\*/"
LINE_COMMENTS = r"//[^\n]*"

# The signatures, by language.
JAVA = (
    ("package declaration", r"\bpackage\s+[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*;"),
    ("Java import", r"\bimport\s+(?:java|javax|android|org)\s*\.\s*[\w$\.]+\s*;"),
    ("Java class declaration", r"\b(?:public\s+|private\s+|protected\s+)?(?:final\s+|abstract\s+)?class\s+[A-Za-z_$][\w$]*\s*(?:extends\b|implements\b|\{|\n)"),
    ("Java main signature", r"\bpublic\s+static\s+void\s+main\s*\(\s*String(?:\[\]|\s+\[\])"),
    ("System output/input", r"\bSystem\s*\.\s*(?:out|in|err)\s*\."),
    ("Java Scanner", r"\bnew\s+Scanner\s*\("),
    ("Java String type", r"\bString\s+[A-Za-z_$][\w$]*\s*(?:=|;|\))"),
    ("Java Character API", r"\bCharacter\s*\.\s*(?:isDigit|isLetter|toLowerCase|toUpperCase)\s*\("),
)
CPP = (
    ("C++ standard header", r"#\s*include\s*[<\"]\s*(?:iostream|vector|string|map|set|queue|stack|algorithm|bits\s*/\s*stdc\+\+\.h|sstream|fstream|iomanip|utility|unordered_map|unordered_set|deque|list|array|cmath|cstdint|cstring|limits|numeric|tuple|type_traits)\s*[>\"]"),
    ("std namespace qualifier", r"\bstd\s*::"),
    ("C++ namespace directive", r"\busing\s+namespace\s+std\s*;"),
    ("C++ stream operator", r"\b(?:cout|cin|cerr|clog)\s*(?:<<|>>)|(?:<<|>>)\s*\b(?:cout|cin|cerr|clog)\b"),
    ("C++ template", r"\btemplate\s*<"),
    ("C++ STL type", r"\b(?:vector|string|map|set|queue|stack|unordered_map|unordered_set|deque|list|array)\s*<\s*[A-Za-z_]"),
    ("C++ nullptr type", r"\bnullptr\b"),
)
C = (
    ("C standard header", r"#\s*include\s*[<\"]\s*(?:stdio|stdlib|string|math|ctype|time|assert|limits|stdint|stdbool|stddef|errno|float|inttypes|locale|signal|setjmp|stdarg|wchar|wctype)\.h\s*[>\"]"),
    ("C stdio function", r"\b(?:printf|fprintf|sprintf|snprintf|scanf|fscanf|sscanf|puts|getchar|putchar)\s*\("),
    ("C allocation function", r"\b(?:malloc|calloc|realloc|free)\s*\("),
    ("C typedef/struct syntax", r"\b(?:typedef\s+(?:struct|enum)|struct\s+[A-Za-z_]\w*\s*\{|enum\s+[A-Za-z_]\w*\s*\{)"),
    ("C sizeof operator", r"\bsizeof\s*(?:\(|[A-Za-z_(])"),
)


def syntax_view(x: str | Column) -> Column:
    """The text without the insides of strings and characters and without comments."""
    out = F.regexp_replace(col(x), STRINGS, '""')
    out = F.regexp_replace(out, CHARS, "''")
    return F.regexp_replace(F.regexp_replace(out, BLOCK_COMMENTS, " "), LINE_COMMENTS, " ")


def matched(view: str | Column, bank: tuple[tuple[str, str], ...]) -> Column:
    """Names of the bank's signatures that occur, in the bank's order."""
    return F.array_compact(F.array(*(F.when(col(view).rlike(pattern), F.lit(name)) for name, pattern in bank)))


def classify(java: str | Column, cpp: str | Column, c: str | Column) -> Column:
    """(detected, status, reason) from the names that three banks matched. Java with C++ is ambiguous; either alone
    wins over C, which counts only by itself."""
    j, p, c = F.size(col(java)) > 0, F.size(col(cpp)) > 0, col(c)
    four = lambda x: F.array_join(F.slice(x, 1, 4), "; ")

    def out(detected: str, status: str, reason: Column) -> Column:
        return F.struct(F.lit(detected).alias("detected"), F.lit(status).alias("status"), reason.alias("reason"))

    say = lambda text, x: F.concat(F.lit(text), four(x))
    return (
        F.when(j & p, out("AMBIGUOUS", "AMBIGUOUS", say("conflicting Java and C++ source signatures: ", F.concat(col(java), col(cpp)))))
        .when(j, out("Java", "NON_C_JAVA", say("Java-only source signatures: ", col(java))))
        .when(p, out("C++", "NON_C_CPP", say("C++-only source signatures: ", col(cpp))))
        .when(F.size(c) > 0, out("C", "CONFIRMED_C", say("C source signatures and no Java/C++-specific signature: ", c)))
        .otherwise(out("AMBIGUOUS", "AMBIGUOUS", F.lit("no decisive source-language signature found in either state")))
    )


def classify_source(earlier: str | Column, later: str | Column) -> Column:
    view = syntax_view(F.concat(F.coalesce(col(earlier), F.lit("nan")), F.lit("\n"), F.coalesce(col(later), F.lit("nan"))))
    return classify(matched(view, JAVA), matched(view, CPP), matched(view, C))
