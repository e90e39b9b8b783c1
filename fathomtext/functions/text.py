"""Text columns: plain text, normal form, identifiers, terms, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathomtext.functions.exprs import bind, clip, strip

# The identifier alphabet.  An identifier is a run of it that holds
# a joint such as ``-`` or ``/``, or mixes letters and digits.
_C = "[A-Za-z0-9µμ°²±×′″$%+]"
_RUN = f"{_C}+(?:·{_C}+)*"
# Where it could start inside a run it could start before it too, so other places are not tried.
IDENTIFIER = (
    f"(?<!{_C})(?:"
    f"{_RUN}(?:[-:/_.+]{_RUN})+"
    f"|(?=[A-Za-z0-9µμ°²±×′″$%+·]*\\+){_RUN}"
    f"|(?=[0-9µμ°²±×′″$%+·]*[A-Za-z])(?=[A-Za-zµμ°²±×′″$%+·]*[0-9]){_RUN}"
    ")"
)

# Function words left out of the terms index.
STOP_WORDS = (
    "的", "了", "是", "在", "和", "与", "对", "为", "及", "等", "或", "一个", "这", "那", "有", "会", "能", "可", "将",
    "从", "把", "被", "以", "其", "之", "并", "但", "而", "因此", "由于", "通过", "对于", "以及", "可以", "同时", "并且",
)

CJK = r"一-鿿"
WORD = r"[\p{L}\p{N}]+"

# Accents the terms index folds away (Latin-1 letters).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


# --- plain text -----------------------------------------------------------------


def plain_text(markdown: Column) -> Column:
    """Readable text of a Markdown fragment; the order of the steps matters."""
    # What each step removes or keeps.
    steps = [
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"`([^`]+)`", "$1"),
        (r"(?mdU)^\s*\|", ""),
        (r"(?mdU)\|\s*$", ""),
        (r"(?mdU)^\s*\|?[\s:|\-]+\|?\s*$", ""),
        (r"(?mdU)^#{1,6}\s+", ""),
        (r"(?d)\*\*(.+?)\*\*|\*(.+?)\*|__(.+?)__|_(.+?)_", "$1$2$3$4"),
        (r"\n{3,}", "\n\n"),
    ]
    out = markdown
    for pattern, kept in steps:
        out = F.regexp_replace(out, pattern, kept)
    return strip(out)


# --- normal form ----------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normal_form(c: Column) -> Column:
    """NFKC of a text.

    Spark has no NFKC.  Texts with characters beyond Latin-1 letters go through a
    vectorized Python function, which sees null in the place of all others.
    """
    foldable = c.rlike(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
    return F.coalesce(_nfkc(F.when(foldable, c)), c)


def with_normal_text(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """NFKC plus white-space folding."""
    return df.withColumn(out_col, fold_spaces(normal_form(F.col(text_col))))


def fold_accents(c: Column) -> Column:
    """Lower case without Latin accents, as the terms index compares words."""
    return F.translate(F.lower(c), ACCENTED, UNACCENTED)


# --- identifiers and terms --------------------------------------------------------


def identifiers(text: Column) -> Column:
    """Distinct identifiers in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0))


def words(text: Column) -> Column:
    """Accent-folded alphanumeric runs in order."""
    return F.regexp_extract_all(fold_accents(text), F.lit(WORD), 0)


def spaced_words(text: Column) -> Column:
    """The same runs in one text, a blank before each and after the last."""
    return F.regexp_replace(F.concat(F.lit(" "), fold_accents(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(fold_accents(text), F.lit(WORD))


class TermTrie:
    """A list of domain terms as one pattern that walks their common beginnings once.

    At each place of a text it takes the longest term that starts there.  The pattern travels with the plan, so the
    list is limited to ``MAX_CHARS`` characters; a longer one is refused rather than cut.
    """

    MAX_CHARS = 1_000_000

    def __init__(self, terms: Iterable[str]):
        root: dict = {}
        size = 0
        for term in sorted({t.lower() for t in terms if t}):
            size += len(term)
            if size > self.MAX_CHARS:
                raise ValueError(f"the domain terms have more than {self.MAX_CHARS} characters")
            node = root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = {}
        self.pattern = self._pattern(root) if root else ""
        # Places where no term can start are passed over by their character.
        self.starts = "".join(re.escape(c) for c in sorted(root))

    def _pattern(self, root: dict) -> str:
        """Nested groups, children first: a term that goes on is tried before the one that ends here."""
        done: dict[int, str] = {}
        stack = [(root, False)]
        while stack:
            node, ready = stack.pop()
            children = [(c, n) for c, n in sorted(node.items()) if c]
            if not ready:
                stack.append((node, True))
                stack.extend((n, False) for _, n in children)
                continue
            parts = [re.escape(c) + done.pop(id(n)) for c, n in children]
            inner = "" if not parts else parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
            done[id(node)] = inner + ("?" if parts and "" in node else "")
        return done[id(root)]

    def segments(self, run: Column) -> Column:
        """Terms of a run and what lies between them, in order, with ``is_term``."""
        one = f"(?=[{self.starts}])(?:{self.pattern})"
        pieces = F.regexp_extract_all(run, F.lit(f"(?s){one}|(?:(?!{one}).)+"), 0)
        return F.transform(pieces, lambda p: F.struct(p.alias("piece"), p.rlike(f"(?s)\\A(?:{one})\\z").alias("is_term")))


def _bigrams(run: Column) -> Column:
    return F.when(F.length(run) <= 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    )


def _cjk_terms(run: Column, domain_terms: Column | TermTrie) -> Column:
    """Domain terms found in a run of CJK characters, else its bigrams.

    A trie cuts the run at the longest terms and gives bigrams of the rest; an array gives all terms that occur besides the bigrams.
    """
    if isinstance(domain_terms, TermTrie):
        if not domain_terms.pattern:
            return _bigrams(run)
        return F.flatten(
            F.transform(domain_terms.segments(run), lambda s: F.when(s["is_term"], F.array(s["piece"])).otherwise(_bigrams(s["piece"])))
        )
    bigrams = _bigrams(run)
    return bind(
        F.filter(domain_terms, lambda t: F.contains(run, t)),
        lambda hit: F.concat(hit, F.filter(bigrams, lambda g: ~F.array_contains(hit, g))),
    )


def terms(text: Column, domain_terms: Column | TermTrie | None = None, fold: bool = True) -> Column:
    """Terms of a text: words, and for CJK runs domain terms or bigrams.

    ``fold`` drops accents as the terms index does; substring search keeps them.
    """
    folded = fold_accents(text) if fold else F.lower(text)
    pieces = F.regexp_extract_all(folded, F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), 0)
    known = F.array().cast("array<string>") if domain_terms is None else domain_terms
    split = F.flatten(
        F.transform(
            pieces,
            lambda p: F.when(p.rlike(f"[{CJK}]"), _cjk_terms(p, known)).otherwise(F.array(p)),
        )
    )
    return F.filter(split, lambda t: ~t.isin(*STOP_WORDS))


def lexical_text(text: Column, domain_terms: Column | TermTrie | None = None) -> Column:
    """Identifiers once each and whole, then the terms of the remaining text."""
    return bind(
        text,
        lambda t: F.array_join(
            F.concat(identifiers(t), terms(F.regexp_replace(t, IDENTIFIER, " "), domain_terms)), " "
        ),
    )


# --- what a query looks for in a passage -------------------------------------------


def lookup_words(query: Column) -> Column:
    """Identifiers of a query, then its words of two characters or more."""
    return F.concat(
        identifiers(query), F.filter(F.split(query, r"(?U)\s+"), lambda w: F.length(w) >= 2)
    )


def snippet(text: Column, query: Column, width: int = 200) -> Column:
    """Window around the first query word that occurs, with ellipses where cut."""
    hits = F.filter(
        F.transform(lookup_words(query), lambda w: F.instr(text, w)), lambda p: p > 0
    )

    def cut(pos: Column) -> Column:
        start = F.greatest(F.lit(0), pos - 1 - width // 4)
        return F.when(
            pos.isNull(),
            F.concat(clip(text, width), F.when(F.length(text) > width, "…").otherwise("")),
        ).otherwise(
            F.concat(
                F.when(start > 0, "…").otherwise(""),
                F.substring(text, start + 1, F.lit(width)),
                F.when(start + width < F.length(text), "…").otherwise(""),
            )
        )

    return bind(F.get(hits, F.lit(0)), cut)


def rerank_text(
    query: Column,
    title: Column,
    heading_path: Column,
    content_type: Column,
    evidence_level: Column,
    text: Column,
    max_chars: int = 1400,
    head: int = 500,
    window: int = 400,
) -> Column:
    """Scoring input of a passage: head plus the surroundings of a query word.

    A word at the very start opens no window, the head covers it.
    """
    hits = F.filter(
        F.transform(lookup_words(query), lambda w: F.instr(text, w)), lambda p: p > 1
    )

    def around(pos: Column) -> Column:
        start = F.greatest(F.lit(0), pos - 1 - window // 2)
        return F.when(pos.isNull(), "").otherwise(
            F.concat(F.lit("\n……\n"), F.substring(text, start + 1, F.lit(window)), F.lit("\n……"))
        )

    body = F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(clip(text, head), bind(F.get(hits, F.lit(0)), around), F.lit("\n……（截断）"))
    )
    level = F.coalesce(F.nullif(evidence_level, F.lit(0)).cast("string"), F.lit("unmarked"))
    return F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("")),
        F.lit("\nSection: "), F.coalesce(heading_path, F.lit("")),
        F.lit("\nContent Type: "), F.coalesce(content_type, F.lit("")),
        F.lit("\nEvidence: L"), level,
        F.lit("\n\n"), body,
    )


def highlight(text: Column, query: Column, mark: str = "mark") -> Column:
    """Wrap query words in a tag, ignoring case; CJK words also by character."""
    raw = F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")
    wanted = F.flatten(
        F.transform(
            raw,
            lambda w: F.when(
                w.rlike(f"[{CJK}]"),
                F.concat(F.array(w), F.regexp_extract_all(w, F.lit(f"[{CJK}]"), 0)),
            ).when(F.length(w) >= 2, F.array(w)).otherwise(F.array().cast("array<string>")),
        )
    )
    escaped = F.transform(
        F.array_distinct(wanted), lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    )
    return bind(
        escaped,
        lambda es: F.when(F.size(es) == 0, text).otherwise(
            F.regexp_replace(
                text,
                F.concat(F.lit("(?iu)("), F.array_join(es, "|"), F.lit(")")),
                F.lit(f"<{mark}>$1</{mark}>"),
            )
        ),
    )


def slug(text: Column, length: int = 40) -> Column:
    """ASCII words of a text joined by dashes, ``task`` when there are none."""
    joined = F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), "-")
    return F.coalesce(F.nullif(F.regexp_replace(clip(joined, length), r"^-+|-+$", ""), F.lit("")), F.lit("task"))
