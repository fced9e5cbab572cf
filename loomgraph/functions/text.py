"""Predicates and scalar functions over text, as Column expressions.

Patterns are Unicode-aware, `(?U)`, as the semantics ask. Only folding, which Spark has no
expression for, is an Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions import vocab as v


def isin(value: Column, words) -> Column:
    return value.isin(*words)


def once(value: Column, body) -> Column:
    """body(value), with the value evaluated once: an expression that is named twice is evaluated twice.

    Not below `fold`: a UDF isn't found in its plan if its argument has lambdas within lambdas.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(words) -> str:
    """A pattern's alternatives, longest first."""
    return "|".join(re.escape(w).replace("/", "\\/") for w in sorted(words, key=len, reverse=True))


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def is_date_like(value: Column) -> Column:
    """Every token a number or a date word, and a year, a numbered era or a month among them."""
    number = lambda x: x.rlike(r"^\d+$")

    def fits(t: Column) -> Column:
        era_next = lambda i: isin(F.try_element_at(t, i + 2), v.ERAS)
        anchored = F.exists(F.transform(t, lambda x, i: F.when(number(x), x.rlike(r"^(1\d{3}|20\d{2})$") | F.coalesce(era_next(i), F.lit(False))).otherwise(isin(x, v.MONTHS))), lambda b: b)
        return (F.size(t) > 0) & F.forall(t, lambda x: number(x) | isin(x, v.DATE_WORDS)) & anchored

    return once(F.transform(tokens(value, r"[A-Za-z]+|\d+"), lambda x: F.lower(x)), fits)


def is_numeric_quantity(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\d,\d{3}"), F.lit(False))


def is_placeholder(value: Column) -> Column:
    """Filler words after an article, nothing at all, or a participant marked as invented."""
    text = F.coalesce(value, F.lit(""))
    bare = F.regexp_replace(F.btrim(F.btrim(text), F.lit(".,;:\"'")), r"(?i)^(?:the|a|an)\s+", "")
    return text.rlike(rf"(?i)\((?:{any_of(v.INVENTED)})\)") | isin(F.lower(F.btrim(bare)), ("", *v.PLACEHOLDERS))


def is_mentionable(name: Column) -> Column:
    return (F.length(name) >= 4) & name.rlike(r"\p{Lu}") & ~is_placeholder(name)


def is_capitalised(token: Column) -> Column:
    return token.rlike(r"^[\p{Lu}\p{Nd}]")


def lemma_key(lemma: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(lemma, F.lit(""))), r"[_\s]+", " "))


def frame_accepts(sense: Column, lemma: Column) -> Column:
    """Whether a verb may carry the sense; only system frames are restricted."""
    out = F.lit(True)
    for frame, verbs in v.FRAME_VERBS.items():
        out = F.when(sense == frame, isin(lemma_key(lemma), verbs)).otherwise(out)
    return out


def split_place(value: Column, most: int = 5) -> Column:
    """Parts of a comma-qualified place, or null where the text doesn't look like one."""
    fine = lambda p: p.rlike(r"^\p{Lu}") & ~p.rlike(r"\d") & ~isin(F.lower(F.split(p, r"\s+")[0]), v.TITLE_WORDS) & (F.size(F.split(p, r"\s+")) <= 5)

    def split(x: Column) -> Column:
        parts = F.transform(F.split(x, ","), lambda p: F.btrim(p))
        return F.when(x.contains(",") & ~is_numeric_quantity(x), once(parts, lambda p: F.when(F.size(p).between(2, most) & F.forall(p, fine), p)))

    return once(value, split)


def split_conjoined(value: Column) -> Column:
    """"A, B and C" as its names where each begins with a capital, else the whole."""
    parts = F.filter(F.transform(F.split(value, r",\s*|\s+and\s+|\s*&\s*"), lambda p: F.btrim(p)), lambda p: p != "")
    return once(parts, lambda each: F.when((F.size(each) > 1) & F.forall(each, lambda p: p.rlike(r"^\p{Lu}")), each).otherwise(F.array(F.btrim(value))))


def lower_first(value: Column) -> Column:
    text = F.btrim(value)
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


#: The patterns of kinship phrases, possessive names, titles and sentence ends in this module.
_KIN = f"(?:(?:the|a|an|his|her|their|its|only)\\s+)?(?:[a-z][a-z'-]*\\s+){{0,3}}?({any_of(v.KIN_NOUNS)})"


def kin_relation(noun: Column) -> Column:
    return once(noun, lambda n: reduce(lambda c, r: c.when(isin(n, [k for k, x in v.KIN_NOUNS.items() if x == r and k not in v.PLURAL_KIN]), r), ("child", "parent", "spouse", "sibling"), F))


def kinship_phrase(value: Column) -> Column:
    """struct(relation, targets) of "sister of X", "son of X and Y", "born to X"; else null."""
    made = lambda relation, target: F.struct(relation.alias("relation"), split_conjoined(target).alias("targets"))

    def said(text: Column) -> Column:
        noun, rest = (F.regexp_extract(text, rf"^{_KIN}\s+(?:of|to)\s+(.+)$", i) for i in (1, 2))
        kin = F.struct(kin_relation(noun).alias("relation"), rest.alias("rest"))
        of = once(kin, lambda k: F.when(k["relation"].isNotNull() & k["rest"].rlike(r"^\p{Lu}"), made(k["relation"], k["rest"])))
        return once(F.regexp_extract(text, r"^(?:born|borne)\s+to\s+(.+)$", 1), lambda born: F.when(born != "", made(F.lit("child"), born)).otherwise(of))

    return once(lower_first(value), said)


def bare_kin_noun(value: Column) -> Column:
    """Relation of "younger son", "eldest daughter"; else null."""
    return kin_relation(F.regexp_extract(lower_first(value), rf"^{_KIN}$", 1))


_NAME = r"[A-Z0-9][\w&.\-]*"


def possessive_association(value: Column) -> Column:
    """struct(owner, owned) of "X's Y" where both are written as names; else null."""
    pattern = rf"(?U)^({_NAME}(?:\s+{_NAME})*)['’]s\s+({_NAME}(?:\s+(?:of|for|and|the|{_NAME}))*)$"
    owned = F.regexp_extract(F.btrim(value), pattern, 2)
    return once(F.regexp_extract(F.btrim(value), pattern, 1), lambda owner: F.when(owner != "", F.struct(owner.alias("owner"), owned.alias("owned"))))


def stem(word: Column) -> Column:
    """Without the first of the suffixes that leaves three letters."""
    w, out = F.lower(word), F.lower(word)
    for s in reversed(v.STEM_SUFFIXES):
        out = F.when((F.length(w) > len(s) + 2) & w.endswith(s), F.substr(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def content_stems(text: Column) -> Column:
    """Distinct stems of content words, in order."""
    words = F.filter(tokens(text, "[A-Za-z]+"), lambda w: (F.length(w) > 2) & ~isin(F.lower(w), v.RELEVANCE_STOP))
    return F.array_distinct(F.transform(words, stem))


def strip_possessives(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=\w)['’]s\b", ""), r"(?<=s)['’](?=\s|$)", "")


def title_of(text: Column) -> Column:
    """Title of "Title. Body", without a trailing parenthesis; else null."""
    raw = F.btrim(F.regexp_extract(F.btrim(text), r"^([A-Z0-9][^\n]{0,120}?)\.\s+(?=[A-Z])", 1))
    bare = F.btrim(F.regexp_replace(raw, r"\s*\([^)]*\)$", ""))
    return F.when(raw != "", F.when(bare != "", bare).otherwise(raw))


def title_names(title: Column) -> Column:
    """The title, without its last parenthesis, and before its first comma; distinct, in order."""
    bare = F.btrim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", ""))
    return F.filter(F.array_distinct(F.array(F.btrim(title), bare, F.btrim(F.split_part(title, F.lit(","), F.lit(1))))), lambda x: x != "")


def sentence_chunks(text: Column, most: int = 900) -> Column:
    """Sentences packed in order into chunks of about `most` characters."""
    whole = F.btrim(F.coalesce(text, F.lit("")))
    sentences = F.split(whole, r"(?<=[.!?])\s+(?=[A-Z0-9\"“(])")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + 1 + F.length(s) > most)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.btrim(F.concat_ws(" ", acc["open"], s))).alias("open"))

    packed = F.aggregate(sentences, start, add, lambda a: F.concat(a["done"], F.when(a["open"] != "", F.array(a["open"])).otherwise(F.array().cast("array<string>"))))
    return F.when(F.length(whole) <= most, F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))).otherwise(packed)


def years(raw: Column) -> Column:
    """struct(start_year, end_year) from a time expression's years; nulls where it has none."""
    def span(found: Column) -> Column:
        first = F.try_element_at(found, F.lit(1)).cast("bigint")
        return F.struct(first.alias("start_year"), F.coalesce(F.try_element_at(found, F.lit(2)).cast("bigint"), first).alias("end_year"))

    return once(tokens(raw, r"\b(?:1\d{3}|20\d{2})\b"), span)


def sense_id(sense: Column) -> Column:
    """`lemma.NN`, lower case; `event.01` for nothing."""
    def told(clean: Column) -> Column:
        number = F.regexp_extract(clean, r"[.\-_](\d{1,2})$", 1)
        lemma = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(clean, r"[.\-_]\d{1,2}$", "")), r"(?U)[^\w\-]", "_"), F.lit("_-"))
        return F.concat(once(lemma, lambda x: F.when(x == "", "event").otherwise(x)), F.lit("."), once(number, lambda x: F.when(x == "", "01").otherwise(F.lpad(x, 2, "0"))))

    return once(F.lower(F.btrim(F.coalesce(sense, F.lit("")))), told)


def relation(value: Column) -> Column:
    """One of the discourse relations, `:cause` where nothing fits."""
    clean = F.lower(F.btrim(F.coalesce(value, F.lit(""))))
    clean = F.when(clean.startswith(":"), clean).otherwise(F.concat(F.lit(":"), clean))
    return F.when(isin(clean, [f":{r}" for r in v.RELATIONS]), clean).when(clean.contains("before") | clean.contains("prior"), ":before").when(clean.contains("after"), ":after").otherwise(":cause")


#: Words by which an unknown role key is placed.
ROLE_WORDS = {
    ":ARG0": ("by", "agent", "actor", "from", "source", "author", "creator", "founder", "owner", "employer", "performer", "subject"),
    ":ARG1": ("to", "target", "theme", "object", "patient", "product", "film", "work", "song", "album"),
    ":location": ("loc", "location", "place", "city", "country", "state", "where", "site", "headquarter", "headquarters"),
    ":time": ("time", "date", "year", "when"),
}


def role_for_key(key: Column) -> Column:
    """A role slot for an unknown role key, by its words."""
    words, out = F.split(F.lower(key), "[^a-z]+"), F.lit(":ARG2")
    for role, known in reversed(ROLE_WORDS.items()):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, known))), role).otherwise(out)
    return out


def hop_count(qid: Column, decomposition: Column) -> Column:
    """Length of the decomposition; else the id's leading number or word; else its numbers."""
    rest = F.when(qid.contains("__"), F.regexp_replace(qid, "^.*?__", "")).otherwise(qid)
    prefix = F.split_part(qid, F.lit("__"), F.lit(1))
    numbers = F.greatest(F.lit(1), F.size(tokens(rest, r"\d+")))
    lead = F.regexp_extract(qid, r"^(\d)hop", 1)
    return F.when(F.size(F.coalesce(decomposition, F.array().cast("array<string>"))) > 0, F.size(decomposition)).when(lead != "", lead.try_cast("int")).when(prefix == "double", 2).when(prefix == "triple", 3).when(prefix == "quadruple", 4).otherwise(numbers)


def source_index(source: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(source, F.lit("")), r":(\d+)$", 1), F.lit("")).try_cast("bigint")


def clean_prediction(raw: Column) -> Column:
    text = F.btrim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^(?:ANSWER|STATUS)\s*:\s*", ""))
    return F.when(text == "NOT_IN_EVIDENCE", "").otherwise(text)


def set_f1(left: Column, right: Column) -> Column:
    """F1 of two arrays as sets: 1 where both are empty."""
    a, b = F.array_distinct(left), F.array_distinct(right)
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(same == 0, 0.0).otherwise(2 * same / (F.size(a) + F.size(b)))


def token_f1(left: Column, right: Column) -> Column:
    """F1 of two token arrays as multisets: 0 without a common token."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    same = F.aggregate(F.array_intersect(left, right), F.lit(0), lambda n, t: n + F.least(count(left, t), count(right, t)))
    return F.when(same == 0, 0.0).otherwise(2 * same / (F.size(left) + F.size(right)))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Case and marks folded away, for comparison."""
    bare = lambda s: s.lower() if s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return text.map(bare, na_action="ignore")


def answer_tokens(answer: Column) -> Column:
    """Tokens of a normalised answer: folded, without punctuation and articles."""
    return tokens_of_folded(fold(F.coalesce(answer, F.lit(""))))


def tokens_of_folded(folded: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(folded, r"(?U)[^\w\s]", " "), r"(?U)\b(a|an|the)\b", " ")
    return F.filter(F.split(F.btrim(text), r"(?U)\s+"), lambda t: t != "")


def without_period(text: Column) -> Column:
    """Text without a sentence's period, which an abbreviation keeps."""
    last = F.element_at(F.split(F.regexp_replace(text, r"\.$", ""), r"\s+"), -1)
    final = text.endswith(".") & (F.length(last) > 2) & ~last.contains(".") & ~isin(F.lower(last), v.ABBREVIATIONS)
    return F.when(final, F.rtrim(F.regexp_replace(text, r"\.$", ""))).otherwise(text)


#: Words that a display form doesn't begin with, where another one follows.
_LEADING = ("with", "by", "from", "to", "at", "for", "in", "on", "as", "the", "a", "an", "his", "her", "their", "its")
#: Names as most are written: words between single spaces, of which no rule below takes one away. Longer ones go through the rules.
_USUAL, _SHORT = rf"^(?!(?:(?i:{any_of(_LEADING)})|{any_of(v.DESCRIPTORS)}) )[\p{{L}}\p{{N}}]++(?: [\p{{L}}\p{{N}}]++)*\z", 80


def _stripped(name: Column) -> Column:
    """A name without quotes around it and without a sentence's period."""
    return without_period(F.btrim(F.btrim(F.btrim(F.coalesce(name, F.lit(""))), F.lit("\"'“”‘’,;:"))))


def surface(name: Column) -> Column:
    """Display form of a name: quotes, sentence period, leading words, and trailing parenthesis off; never empty."""
    whole, told = F.btrim(F.coalesce(name, F.lit(""))), _stripped(name)
    text = told
    for pattern in (r"(?i)^(?:with|by|from|to|at|for|in|on|as)\s+", r"['’]s$", r"(?i)^(?:the|a|an)\s+", r"(?i)^(?:his|her|their|its)\s+", rf"^(?:{any_of(v.DESCRIPTORS)})\s+(?=[A-Z])", r"\s*\([^)]*\)\s*$"):
        text = F.btrim(F.regexp_replace(text, pattern, ""))
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    # the first that isn't empty; a `when` would make the text twice
    some = F.coalesce(F.try_element_at(F.array_remove(F.array(text, whole), F.lit("")), F.lit(1)), F.lit(""))
    return F.when((F.length(told) <= _SHORT) & told.rlike(_USUAL), told).otherwise(some)


def _turned(name: Column) -> Column:
    """Display form with "City of X" as "X City"."""
    shown = surface(name)
    admin = rf"(?i)^({any_of(v.ADMIN_NOUNS)})\s+of\s+(.+)$"
    return F.regexp_replace(shown, admin, "$2 $1")


def name_variants(name: Column) -> Column:
    """A name without possessives, and that without its parentheses; distinct."""
    base = F.btrim(strip_possessives(name))
    bare = F.btrim(F.regexp_replace(base, r"\s*\([^)]*\)", ""))
    return F.array_distinct(F.array(base, F.when(bare != "", bare).otherwise(base)))


def name_tokens(text: Column) -> Column:
    """Folded tokens of a name without possessives and articles."""
    return F.filter(F.split(fold(strip_possessives(text)), r"(?U)[^\w']+"), lambda x: (x != "") & ~x.isin("the", "a", "an"))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether an array's elements are in another in their order."""
    at = F.aggregate(long, F.lit(0), lambda i, x: F.when((i < F.size(short)) & (F.try_element_at(short, i + 1) == x), i + 1).otherwise(i))
    return at == F.size(short)


#: Words that a key leaves out, where others stay.
_SMALL = ("the", "a", "an", "of", "and")


def _key_of(folded: Column) -> Column:
    """No lambda within a lambda: `slug` folds a key, and a UDF isn't found over one."""
    every = F.split(folded, r"(?U)[^\w]+")
    told = F.exists(every, lambda w: ~w.isin("", *_SMALL))
    text = F.array_join(F.when(told, F.filter(every, lambda w: ~w.isin("", *_SMALL))).otherwise(F.filter(every, lambda w: w != "")), " ")
    text = F.regexp_replace(text, rf"^(?:{any_of(v.HONORIFICS)}) (?=\S+ \S)", "")
    suffix = rf"^(\S+(?: \S+)*?)(?: (?:{any_of(v.LEGAL_SUFFIXES)}))+$"
    text = F.regexp_replace(text, suffix, "$1")
    text = F.regexp_replace(text, r"(?U)(?<=(?:^| )\p{L}) (?=\p{L}(?: |$))", "")
    return F.regexp_replace(text, suffix, "$1")


#: Names whose key is their lower case: in ASCII, without the words and single letters that a key leaves out or joins.
_PLAIN = rf"(?i)^(?!(?:{any_of((*_LEADING, *v.DESCRIPTORS, *v.HONORIFICS))}) )(?:(?!(?:{any_of((*_SMALL, *v.LEGAL_SUFFIXES))}|[a-z])(?: |\z))[a-z0-9]++(?: (?=[a-z0-9])|\z))+\z"


def _plain(told: Column) -> Column:
    return (F.length(told) <= _SHORT) & told.rlike(_PLAIN)


def match_key(name: Column) -> Column:
    """Key under which two mentions are one entity. Most names need no folding, and no row of theirs any patterns but one."""
    told = _stripped(name)
    return F.when(_plain(told), F.lower(told)).otherwise(_key_of(fold(F.when(~_plain(told), _turned(name)))))


def match_keys(names: Column) -> Column:
    """Match keys of an array of names, folded together."""
    plain = F.forall(names, lambda n: _plain(_stripped(n)))
    folded = fold(F.when(~plain, F.array_join(F.transform(names, _turned), "\x1f")))
    keys = F.when(plain, F.transform(names, lambda n: F.lower(_stripped(n)))).otherwise(F.transform(F.split(folded, "\x1f"), _key_of))
    return F.when(F.size(names) > 0, keys).otherwise(F.array().cast("array<string>"))


def slug(key: Column, most: int = 60) -> Column:
    """Printable id of a key; a hash where no letter is left.

    A key is to be written before: made in the same plan, it has a row name its value thousands of times while it waits for Python.
    """
    plain = (F.length(key) <= most) & key.rlike(r"^[a-z0-9]++(?: [a-z0-9]++)*\z")
    text = F.btrim(F.regexp_replace(fold(F.when(~plain, key)), r"(?U)[^\w]+", "_"), F.lit("_"))
    digest = F.sha1(key.cast("binary"))
    long = F.concat(F.rtrim(F.regexp_replace(F.substring(text, 1, most), "_+$", "")), F.lit("_"), F.substring(digest, 1, 6))
    return F.when(plain, F.translate(key, " ", "_")).when(text == "", F.concat(F.lit("h"), F.substring(digest, 1, 12))).when(F.length(text) > most, long).otherwise(text)


#: Terms of each relation class.
RELATION_TERMS = {
    "spouse": ("spouse", "wife", "husband", "married", "marry", "partner"),
    "child": ("child", "son", "daughter", "children", "offspring"),
    "parent": ("father", "mother", "parent", "parents"),
    "sibling": ("brother", "sister", "sibling", "siblings"),
    "border": ("border", "borders", "adjacent", "neighbor", "neighboring", "shares a border"),
    "headquarters": ("headquartered", "headquarters", "based", "hq", "located"),
    "location": ("located", "province", "district", "county", "state", "city", "country", "territory", "borough"),
    "birthplace": ("born", "birthplace", "birth place", "native of"),
    "education": ("educated", "school", "college", "university", "alumnus", "alumna", "studied"),
    "founded": ("founded", "established", "co-founded", "creator", "created", "started"),
    "league": ("league", "plays in", "competes in", "division", "club", "team"),
    "record_label": ("record label", "signed", "label", "records", "released by"),
    "work": ("author", "writer", "wrote", "book", "novel", "play", "composed", "performer", "album", "song"),
    "ownership": ("owner", "owns", "owned by", "property of", "subsidiary", "parent company"),
    "manufacturer": ("manufacturer", "manufactured", "maker", "made by", "aircraft"),
}


def relations(question: Column) -> Column:
    """Names of the relation classes that a question has a term of, as whole words."""
    text = F.lower(question)
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?U)\b(?:{any_of(terms)})\b"), name) for name, terms in RELATION_TERMS.items()]))
