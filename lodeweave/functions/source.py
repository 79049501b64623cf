"""Column functions over source texts and rendered documents; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file extensions by their comments
C_FILES = ".c .h .cpp .cc .cxx .hpp .hxx .m .mm".split()
SLASH_FILES = ".js .jsx .ts .tsx .go .java .kt .swift .rs .cs .scala .rb".split()
HASH_FILES = ".py .pyi".split()

# fixed values: capital words that are no global of the program
NO_GLOBALS = """
None True False NULL EOF OK ERR MAX MIN PI NaN INF INT STR BOOL LIST DICT SET GET PUT POST HTTP HTTPS URL URI API IO ID OS DB
UI LF CR TAB UTF ASCII JSON XML SQL CSV PDF PNG JPG GIF SVG
DEFINE IFDEF IFNDEF ENDIF INCLUDE PRAGMA RETURN BREAK CONTINUE STATIC EXTERN CONST VOID INT CHAR LONG FLOAT DOUBLE UINT SIZE_T
INT64 INT32 INT16 INT8
""".split()

# fixed values: keywords, type names and common names of local variables
LOCAL_WORDS = """
auto break case char const continue default do double else enum extern float for goto if inline int long register restrict
return short signed sizeof static struct switch typedef union unsigned void volatile while
bool catch class delete explicit false friend namespace new operator private protected public template this throw true try
typename using virtual
i j k n p q r s t x y z ret err res val tmp buf ptr len size type name data idx pos end start count result status offset
index value flag mask node list head next prev left right key
""".split()

# fixed values: the shapes of names that count as globals
DECLARED = r"\bglobal\s+([^\n#]+)"
CAPITAL = r"\b([A-Z][A-Z0-9_]{2,})\b"
CHANGED = r"(?m)^[ \t]{0,8}([a-z_][a-zA-Z0-9_]{2,})\s*(?:\+\+|--|[+\-*/%&|^]=|=(?!=))"
POINTED = r"\b([a-z_][a-zA-Z0-9_]+)\s*->"
BEGUN = r"\b((?:nb_|g_|cur_|last_|prev_|next_|num_|is_|has_)[a-zA-Z][a-zA-Z0-9_]+)\b"

_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' + "|" + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
#: One pass from left to right: a string is taken whole, so marks of comments inside it are none; an open block ends with the text.
_SLASH = rf"(?s)({_STRING})|//[^\n]*+|/\*.*?(?:\*/|\z)"
_HASH = rf"(?s)\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)|({_STRING})|#[^\n]*+"


def without_comments(source: Column, extension: Column) -> Column:
    """A source text with each comment as one space, by the comments of its file's extension; texts of other files as they are.

    In Python files texts between three quotes count as comments. Strings are kept and get a space behind them; a quote that
    is not closed on its line is a character like others.
    """
    kind = F.lower(F.coalesce(extension, F.lit("")))
    return F.when(kind.isin(*C_FILES, *SLASH_FILES), F.regexp_replace(source, _SLASH, "$1 ")).when(kind.isin(*HASH_FILES), F.regexp_replace(source, _HASH, "$1 ")).otherwise(source)


def _bare(parameter: Column) -> Column:
    """The name of a typed parameter: what stands behind the last blank, mark or bracket."""
    return F.regexp_extract(F.trim(parameter), r"([^\s*&,<>]*)$", 1)


def referenced_globals(source: Column, parameters: Column, extension: Column) -> Column:
    """The sorted names of globals that a function's source seems to use.

    Names after ``global`` (not in C), capital names of four characters or with an underscore, and in C files names that are
    changed at the start of a statement, pointed through with ``->``, or begin like globals do. Names of ``parameters`` (an
    array of typed parameters) and common words are left out.
    """
    code = without_comments(source, extension)
    is_c = F.lower(F.coalesce(extension, F.lit(""))).isin(*C_FILES)

    def every(pattern: str) -> Column:
        return F.regexp_extract_all(code, F.lit(pattern), F.lit(1))

    none = F.array().cast("array<string>")
    declared = F.flatten(F.transform(every(DECLARED), lambda x: F.split(F.trim(x), r"[,\s]+")))
    declared = F.filter(declared, lambda x: x.rlike(r"^[A-Za-z_]\w*$"))
    capital = F.filter(every(CAPITAL), lambda x: (F.contains(x, F.lit("_")) | (F.length(x) >= 4)) & ~x.isin(*NO_GLOBALS))
    changed, pointed, begun = every(CHANGED), every(POINTED), every(BEGUN)
    in_c = F.filter(F.concat(changed, pointed, begun), lambda x: ~x.isin(*LOCAL_WORDS))
    found = F.concat(capital, F.when(is_c, in_c).otherwise(F.coalesce(declared, none)))
    own = F.filter(F.transform(F.coalesce(parameters, none), _bare), lambda x: x != "")
    return F.sort_array(F.array_except(F.array_distinct(found), own))


def descriptions(doc: Column) -> Column:
    """(chinese, english, first): a description's lines behind the marks of both languages, and the first sentence where there is neither."""
    chinese = F.trim(F.regexp_extract(doc, "中文[:：]\\s*([^\n]+)", 1))
    english = F.trim(F.regexp_extract(doc, "English[:：]\\s*([^\n]+)", 1))
    first = F.when(F.contains(doc, F.lit(".")), F.concat(F.trim(F.substring_index(doc, ".", 1)), F.lit("."))).otherwise(doc)
    return F.struct(F.nullif(chinese, F.lit("")).alias("chinese"), F.nullif(english, F.lit("")).alias("english"), F.when((chinese == "") & (english == ""), first).alias("first"))


def callee_names(tree: Column) -> Column:
    """Names in the lines of a call tree (list marks or guides in front), each once in order of appearance."""
    lines = F.transform(F.split(tree, "\n"), lambda x: F.regexp_extract(F.trim(x), r"^(?:[-*]|[├└│]──?)\s*`?([A-Za-z_][\w.:]*)", 1))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def module_functions(doc: Column) -> Column:
    """Entries ``name: signature — description`` of the table rows of a module's document; null where it is shorter than 50
    characters or has no title or rows. Empty and dash descriptions are left out."""
    lines = F.split(doc, r"\r?\n")
    rows = F.filter(lines, lambda x: F.startswith(x, F.lit("| [")) & (F.size(F.split(x, r"\|", -1)) >= 4))

    def entry(line: Column) -> Column:
        cells = F.split(line, r"\|", -1)
        name, signature, text = (F.trim(F.get(cells, F.lit(i))) for i in (1, 2, 3))
        name = F.when(F.contains(name, F.lit("](")), F.regexp_replace(F.substring_index(name, "](", 1), r"^\[+", "")).otherwise(name)
        return F.concat(name, F.lit(": "), F.regexp_replace(signature, "^`+|`+$", ""), F.when((text != "") & (text != "—"), F.concat(F.lit(" — "), text)).otherwise(""))

    title = F.exists(lines, lambda x: F.startswith(x, F.lit("# ")) & (F.trim(F.substring(x, 3, 1_000_000)) != ""))
    return F.when((F.length(doc) >= 50) & title & (F.size(rows) > 0), F.transform(rows, entry))
