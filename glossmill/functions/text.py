"""Text functions as Column -> Column, all inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose period ends no sentence.
ABBREVIATIONS = (
    "št čl odst tč al odd pt str op cit ur l npr oz ipd itd tj prim gl sl g ga dr mag univ prof inž ing d.o.o d.d d.n.o k.d s.p z.o.o r.š e.š davč mat reg "
    "odv izv zap sod tož obd ovad pooblašč pril vlož fasc tel faks sob nasl obr no art sec para pp cf eg ie etc vs v mr mrs ms jr sr inc ltd co corp bzw ggf usw z.B u.a Abs Nr vgl Bd"
).split()
# Fragments that are reproduced verbatim, in order.
VERBATIM = [
    r"[IVX]+\s+[A-ZČŠŽ][a-zčšž]{0,3}\s+\d+/\d{4}",
    r"\d+[-/]\d+(?:[-/]\d+)*",
    r"\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4}\.?",
    r"[\d.,]+\s?(?:EUR|USD|CHF|€|\$)",
    r"\b[A-ZČŠŽ][A-Za-zČčŠšŽž]{1,9}-\d+[A-Z]?\b",
    r"\b(?:ZKP|ZPP|ZUP|ZIZ|ZUS|ZDR|ZGD|ZPIZ|ZDavP|ZFPPIPP|ZDIJZ|ZASP|URS|EKČP|OZ|SPZ|KZ)\b",
    r"\b(?:EUR|USD|CHF|GBP|SIT)\b",
    r"OCR_ILLEGIBLE",
    r"[A-Z0-9]{2,}(?:[-/][A-Z0-9]+)+",
    r"[\w.+-]+@[\w.-]+\.\w+",
    r"https?://\S+",
]
# Month names by number.
MONTHS = {
    1: "january januar januarja jan", 2: "february februar februarja feb", 3: "march marec marca mar märz", 4: "april aprila apr", 5: "may maj maja mai",
    6: "june junij junija jun juni", 7: "july julij julija jul juli", 8: "august avgust avgusta aug", 9: "september septembra sep sept",
    10: "october oktober oktobra oct okt", 11: "november novembra nov", 12: "december decembra dec dezember",
}
# Words that carry no terminology.
SOURCE_STOP = "in je so na za se ki po pri od do iz ali ter pa kot bo bil bila bilo ne da s z v o a the of to and ta te ti tega tem tej tudi lahko mora sme če kadar vseh".split()
TARGET_STOP = "the of to and a an in on for with by is are was were be been shall may must or that this these those as at from it its not if when any all such which has have had".split()
# Fixed value: citations of statutes and treaties.
CITATION = (
    r"\bčl\.|\bčlen\w*|\bodst\.|\bodstav\w*|\btočk\w*|\balinej\w*|\bUstav\w*|\bEKČP\b|\bEKPČ\b|\bKonvencij\w*"
    r"|\b(?:KZ|ZKP|ZPP|ZUP|ZIZ|ZUS|ZDR|ZGD|ZPIZ|ZDavP|ZFPPIPP|ZASP|OZ|SPZ)\b(?:-\d+[A-Z]?)?|\bUradni\s+list\b|\bUr\.\s?l\."
)
CUT, HELD = "\ue000", "\ue001"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression that stands in a lambda is otherwise computed for each element."""
    return F.transform(F.array(value), use)[0]


#: Fixed value: all white space, the same as \\s with Unicode classes.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    return F.btrim(_col(c), F.lit(WHITE))


def lines(c) -> Column:
    return F.split(F.translate(F.coalesce(_col(c), F.lit("")), "\r\u00a0" + CUT, "   "), "\n")


_ENDS = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
_HELD = rf"(?U)(?:\b(?iu:{_ENDS})|\b[IVXLCDM]+|\b[A-ZČŠŽÄÖÜ]|(?<![^\s])\d{{1,3}}(?:\.\d{{1,3}})*|\b[a-zčšžćđ])\.\z"


def segment(c) -> Column:
    """Review-sized segments: lines, cut after sentence ends unless these end an abbreviation, initial, numeral or number."""
    marked = F.transform(lines(c), lambda x: F.regexp_replace(strip(x), r"([.!?:;])\s+", "$1" + CUT))
    # What holds a cut back stands in the last word before it, so that no more than this word is searched.
    held = lambda x: x.endswith(".") & F.substring_index(x, " ", -1).rlike(_HELD)
    joined = F.transform(F.split(F.array_join(marked, "\n"), CUT), lambda x: F.concat(x, F.when(held(x), " ").otherwise(CUT)))
    return F.filter(F.transform(F.split(F.translate(F.array_join(joined, ""), "\n", CUT), CUT), strip), lambda x: x != "")


def tokens(c) -> Column:
    """Lower-case runs of two letters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[\p{L}\p{Nl}\p{No}]{2,}"), F.lit(0))


def words(c) -> Column:
    """Runs without space."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\S+"), F.lit(0))


_WHOLE = "(?U)^(?:" + "|".join(VERBATIM) + ")$"
# Of each of VERBATIM, in order: texts without any of these signs hold no match and aren't searched.
_SIGNS = [["/"], ["-", "/"], ["."], ["EUR", "USD", "CHF", "€", "$"], ["-"], [], [], [], ["-", "/"], ["@"], ["http"]]
# Those that are lists of words, and the letters that words begin with, which are looked for before the edge of a word, as that takes longer.
_WORDS = {i: VERBATIM[i].removeprefix(r"\b(?:").removesuffix(r")\b").split("|") for i in (5, 6, 7)}
_FIRST = {4: "(?=[A-ZČŠŽ])", 5: "(?=[ZUEOSK])", 6: "(?=[EUCGS])"}


def verbatim_without(c, other: Column) -> Column:
    """The fragments that are reproduced verbatim, by pattern, then place; those that other has may be left out."""
    s, none = _col(c), F.array().cast("array<string>")
    found = []
    for i, (pattern, signs) in enumerate(zip(VERBATIM, _SIGNS, strict=True)):
        held = [s.contains(x) & ~other.contains(x) for x in _WORDS[i]] if i in _WORDS else [s.contains(x) for x in signs]
        found.append(F.when(reduce(Column.__or__, held), F.regexp_extract_all(s, F.lit(f"(?U){_FIRST.get(i, '')}{pattern}"), F.lit(0))).otherwise(none))
    return F.concat(*found)


def is_translatable(c) -> Column:
    return let(strip(F.coalesce(_col(c), F.lit(""))), lambda s: (F.length(s) >= 2) & s.rlike("[A-Za-zČčŠšŽžÄäÖöÜüß]{2,}") & ~s.rlike(_WHOLE))


def count_of(c, signs: str) -> Column:
    """How many characters of a class like [a-z] a text has, by what is left without them."""
    return (F.length(_col(c)) - F.length(F.regexp_replace(_col(c), signs + "+", ""))).cast("long")


def script(c) -> Column:
    """none, armenian, cyrillic or latin, by shares over 30 %."""
    counts = F.struct(count_of(c, r"[\u0530-\u058F]").alias("a"), count_of(c, r"[\u0400-\u04FF]").alias("y"), count_of(c, "[A-Za-zČčŠšŽžĆćĐđ]").alias("n"))

    def of(s: Column) -> Column:
        total = s["a"] + s["y"] + s["n"]
        return F.when(total == 0, "none").when(s["a"] / total > 0.30, "armenian").when(s["y"] / total > 0.30, "cyrillic").otherwise("latin")

    return let(counts, of)


def xml_safe(c) -> Column:
    """Form feeds become newlines; signs that XML forbids go."""
    return F.regexp_replace(F.translate(_col(c), "\f", "\n"), r"[\x00-\x08\x0b\x0e-\x1f\ufffe\uffff]", "")


def target_name(c, suffix: str) -> Column:
    """Stem, suffix and the extension of the deliverable."""
    ext = F.regexp_extract(_col(c), r"(\.[^./]*)$", 1)
    stem = F.substring(_col(c), F.lit(1), F.length(_col(c)) - F.length(ext))
    low = F.lower(ext)
    mapped = F.when(low.isin(".pdf", ".txt"), ".docx").when(low.isin(".xlsm", ".xltx", ".xltm"), ".xlsx").otherwise(ext)
    return F.concat(stem, F.lit(suffix), mapped)


def sanitise(c) -> Column:
    return F.translate(_col(c), "\t\n", "  ")


# Clock times with a half of the day, and numbers with separators (with and without the dash).
_HALF_DAY = r"(?U:\b)(\d{1,2}):(\d{2})\s*([ap])\.?\s*m\.?"
NUMBER, NUMBER_SEQUENCE = r"\d[\d.,:/\u2013-]*\d|\d", r"\d[\d.,:/-]*\d|\d"


def _in_24_hours(m: Column) -> Column:
    """12 stands for 0 before noon; any other hour counts as it is, with 12 more after noon."""
    part = lambda i: F.regexp_extract(m, f"(?i){_HALF_DAY}", i)
    h, late = part(1).cast("int"), F.lower(part(3)) == "p"
    hour = F.when(h == 12, F.when(late, 12).otherwise(0)).when(late, h + 12).otherwise(h)
    return F.concat(F.when(hour < 10, "0").otherwise(""), hour.cast("string"), F.lit(":"), part(2))


def _prefix_tree(names: list[str]) -> str:
    """A pattern of these names that looks at each letter once."""
    heads = sorted({x[0] for x in names if x})
    tails = "|".join(h + _prefix_tree([x[1:] for x in names if x[:1] == h]) for h in heads)
    return f"(?:{tails}){'?' * ('' in names)}" if heads else ""


_NUMBER_OF = {x: str(n) for n, names in MONTHS.items() for x in names.split()}
_MONTH = rf"(?iuU)(?=[{''.join(sorted({x[0] for x in _NUMBER_OF}))}])\b{_prefix_tree(list(_NUMBER_OF))}\b"

_MONTH_BEGINS = _prefix_tree(sorted({x[:3] for x in _NUMBER_OF}))


def _with_months(s: Column) -> Column:
    """A month is a whole word. The text is cut where the pattern sees one (a split by a pattern would compile it for each text); what it takes for one by other foldings of case stays."""
    table = F.create_map(*[F.lit(x) for pair in _NUMBER_OF.items() for x in pair])
    number = lambda x: F.when(F.lower(x).isin(*_NUMBER_OF), F.element_at(table, F.lower(x))).otherwise(x)
    # A sign that stands for a cut in the text itself is set aside.
    plain = F.replace(s, F.lit(CUT), F.lit(HELD))
    told = let(F.regexp_replace(plain, _MONTH, f"{CUT}$0{CUT}"), lambda m: F.when(m.contains(CUT), F.array_join(F.transform(F.split(m, CUT), number), "")).otherwise(m))
    return F.when(s.contains(HELD), F.array_join(F.transform(F.split(s, r"(?U)\b"), number), "")).otherwise(F.replace(told, F.lit(HELD), F.lit(CUT)))


def canon_locale(c) -> Column:
    """Clock times in 24 hours and month names as numbers."""
    s = F.coalesce(_col(c), F.lit(""))
    found = F.regexp_extract_all(s, F.lit(f"(?i){_HALF_DAY}"), F.lit(0))
    timed = F.array_join(F.zip_with(F.split(s, f"(?i){_HALF_DAY}", -1), found, lambda rest, m: F.concat(rest, F.coalesce(_in_24_hours(m), F.lit("")))), "")
    timed = F.when(s.contains(":") & s.rlike(r"(?i)\d:\d\d\s*[ap]\.?\s*m"), timed).otherwise(s)
    return F.when(F.lower(s).rlike(_MONTH_BEGINS), let(timed, _with_months)).otherwise(timed)


def _digits(x: Column, others: str) -> Column:
    return F.translate(x, others, "")


def numbers(c) -> Column:
    """Digits of the numbers in a text, without leading zeros, after canon_locale."""
    found = F.regexp_extract_all(canon_locale(c), F.lit(NUMBER), F.lit(0))
    plain = F.transform(found, lambda x: _digits(x, ".,:/\u2013-"))
    return F.transform(plain, lambda x: F.when(x.startswith("0"), F.regexp_replace(x, r"^0+(?=.)", "")).otherwise(x))


def number_sequence(c) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(NUMBER_SEQUENCE), F.lit(0))
    return F.transform(found, lambda x: _digits(x, ".,:/-"))


def more_in(a: Column, b: Column) -> Column:
    """Sorted distinct values that a holds more often than b."""
    times = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.array_sort(F.filter(F.array_distinct(s["a"]), lambda v: times(s["a"], v) > times(s["b"], v))))


def _slicer(xs: Column, n: int):
    return lambda i: F.slice(xs, i, F.lit(n))


def phrases(c, stop: list[str], most: int = 3) -> Column:
    """Distinct lower-case phrases of up to three words, without stopwords at the edges, numbers, or fewer than four letters."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return let(toks, lambda t: _phrases(t, stop, most))


def _phrases(toks: Column, stop: list[str], most: int) -> Column:
    halt = F.array(*map(F.lit, stop))
    grams = []
    for n in range(1, most + 1):
        at = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams.append(F.transform(at, _slicer(toks, n)))
    keep = lambda g: ~F.array_contains(halt, g[0]) & ~F.array_contains(halt, F.element_at(g, -1)) & ~F.exists(g, lambda t: t.rlike(r"^\d+$")) & (F.length(F.array_join(g, "")) >= 4)
    return F.array_distinct(F.transform(F.filter(F.concat(*grams), keep), lambda g: F.array_join(g, " ")))


def citations(c) -> Column:
    """Distinct citations, ordered by their lower-case form without the sign on c, then by themselves."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(f"(?iuU)(?:{CITATION})"), F.lit(0)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.translate(F.lower(x), "č", "c").alias("k"), x.alias("v")))), lambda s: s["v"])


def without_thoughts(c) -> Column:
    return F.regexp_replace(_col(c), r"(?s)<think>.*?</think>", "")


def without_fences(c) -> Column:
    return strip(F.regexp_replace(_col(c), r"(?m)^```[^\n]*$", ""))


#: Names that a prompt gives to languages.
LANGUAGES = {"sl": "Slovene", "en": "English", "de": "German"}


def build_prompt(layers: list, src: str, tgt: str, block) -> Column:
    """The last layer of a template that is there (kit, shared, project), with its places for the languages and the glossary filled in."""
    template = F.coalesce(*[_col(x) for x in reversed(layers)])
    out = F.replace(template, F.lit("{SRC}"), F.lit(LANGUAGES.get(src, src)))
    return F.replace(F.replace(out, F.lit("{TGT}"), F.lit(LANGUAGES.get(tgt, tgt))), F.lit("{GLOSSARY}"), F.coalesce(_col(block), F.lit("")))


def memo_key(*parts) -> Column:
    """Digest of the parts that decide a translation; a null part (an empty glossary block) is left out."""
    return F.sha2(F.concat_ws("\u0000", *[_col(p) for p in parts]), 256)


def one_line(c) -> Column:
    """Whether a segment can go in a numbered batch."""
    s = _col(c)
    return ~s.contains("\n") & (F.length(s) <= 200) & ~s.rlike(r"^\s*\d+\s*[.)]")
