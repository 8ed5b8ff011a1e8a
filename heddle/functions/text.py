"""Scalar text functions: tokens, keywords, intents, names, hashes and embedding texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of a descriptive query.
QUERY_STOP_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "in", "on", "at", "to", "from", "of", "for", "with", "without", "into", "onto", "upon", "via",
    "by", "as", "about", "against", "between", "across", "through", "during", "before", "after", "above", "below", "and", "or", "but", "nor", "so", "yet",
    "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "has", "have", "had", "can", "could", "should", "would", "will", "shall",
    "may", "might", "must", "how", "what", "where", "when", "why", "which", "who", "whom", "i", "me", "my", "you", "your", "we", "us", "our", "it", "its",
    "they", "them", "their", "show", "find", "list", "get", "construction", "configuration", "implementation", "registration", "initialization",
    "initialisation", "destruction", "creation",
)

# Words that name no module.
MODULE_STOP_WORDS = (
    "how", "does", "work", "the", "and", "for", "with", "from", "this", "that", "what", "which", "when", "where", "explain", "overview", "architecture",
    "flow", "flows", "file", "files", "code", "used", "uses", "using", "made", "make", "makes", "works", "system", "leverage", "leverages", "leveraging",
    "repo", "repos", "short", "concise", "chart", "charts", "give", "tell", "show", "walk", "through", "trace", "step", "steps",
)

# Suffixes that are cut off a keyword, in order.
SUFFIXES = ("ing", "ed", "er", "es", "ion", "s")

# Phrases of each intent, in the order in which intents are tried.
INTENTS = (
    ("howto", (r"\bwalk\s+me\s+through\b", r"\bend[-\s]to[-\s]end\b", r"\btrace\s+(the|a|an)?\b", r"\bstep[-\s]by[-\s]step\b", r"\bshow\s+me\s+the\s+(flow|flows?)\b")),
    (
        "design",
        (
            r"^\s*(?:re-?)?(add|implement|extend|support|enforce|send|show|resolve|build|create|wire|integrate|expose|migrate|refactor|introduce|enable|"
            r"update|allow|persist|delete|remove|stream|ingest|compute|prioriti[sz]e|record|replace|rename|cache|batch)\b",
        ),
    ),
    (
        "conceptual",
        (
            r"\bhow\s+(does|do|is|are)\b",
            r"\bexplain\b",
            r"\boverview\s+of\b",
            r"\barchitecture\b",
            r"\bwhat\s+is\s+the\s+(flow|architecture|structure|design)\b",
            r"\bwalk\s+me\s+through\b",
            r"\bwhat\s+(tools|libraries|libs|dependencies|packages|modules|features|apis|endpoints|routes|parsers|adapters|services|components|tests)\b",
            r"\bwhat\s+does\s+it\s+(use|leverage|depend\s+on|call|import|expose)\b",
            r"\blist\s+(all\s+)?(the\s+)?(tools|modules|endpoints|routes|services|components|parsers|features)\b",
        ),
    ),
)

TOKEN = "([A-Za-z][A-Za-z0-9]+)"
CARD_SUFFIX = "::Symbol::card"


def tokens(text: Column) -> Column:
    """Lexical tokens: ASCII words of two characters or more that start with a letter, in lower
    case; dots and underscores separate."""
    return F.transform(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "._", "  "), F.lit(TOKEN), F.lit(1)), F.lower)


def rewritten_query(raw: Column) -> Column:
    """Struct (text, outcome): a descriptive query without its stop words, or as it was and why."""
    plain = F.trim(F.regexp_replace(raw, r"\?+$", ""))
    words = F.filter(F.split(plain, r"\s+"), lambda t: t != "")
    kept = F.filter(words, lambda t: ~F.lower(t).isin(*QUERY_STOP_WORDS))
    outcome = (
        F.when(F.size(words) < 4, "skip-short")
        .when(F.exists(words, lambda t: t.rlike("[._-]")), "skip-symbol-like")
        .when(F.size(kept) < 2, "skip-overstrip")
        .otherwise("applied")
    )
    return F.struct(F.when(outcome == "applied", F.array_join(kept, " ")).otherwise(raw).alias("text"), outcome.alias("outcome"))


def intent(text: Column) -> Column:
    """howto, design, conceptual or symbol: the first whose phrases the text has."""
    out = reduce(lambda acc, i: acc.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in i[1])), i[0]), INTENTS[1:], F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in INTENTS[0][1])), INTENTS[0][0]))
    return out.otherwise("symbol")


def stem(word: Column) -> Column:
    """Root of a word of five letters or more, or null."""

    def cut(suffix: str) -> Column:
        root = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        n = F.length(root)
        doubled = (n > 3) & (F.substring(root, n, F.lit(1)) == F.substring(root, n - 1, F.lit(1)))
        return F.when(doubled, F.substring(root, F.lit(1), n - 1)).otherwise(root)

    out = F.lit(None).cast("string")
    for suffix in reversed(SUFFIXES):  # a suffix whose root is too short gives way to the next
        out = F.when(word.endswith(suffix) & (F.length(cut(suffix)) >= 3), cut(suffix)).otherwise(out)
    return F.when(F.length(word) >= 5, out)


def module_keywords(text: Column, most: int = 12) -> Column:
    """Words of four characters or more that may name a module, each followed by its stem."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z0-9_-]{3,})"), F.lit(1)), F.lower)
    usable = F.filter(words, lambda w: ~w.isin(*MODULE_STOP_WORDS))
    both = F.flatten(F.transform(usable, lambda w: F.array(w, stem(w))))
    return F.slice(F.array_distinct(F.filter(both, lambda w: w.isNotNull() & ~w.isin(*MODULE_STOP_WORDS))), 1, most)


def content_hash(text: Column, most: int = 4096) -> Column:
    """SHA-1 of the text as it is embedded, cut to ``most`` characters."""
    return F.sha1(F.substring(text, 1, most))


def embed_text(kind: Column, name: Column, module: Column, callers: Column, doc: Column, source: Column) -> Column:
    """Text of a symbol for embedding; parts that are null or empty are left out."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    head = F.concat_ws("\n", F.concat(F.lit("# "), kind, F.lit(": "), name), part("# Module: ", module), part("# Callers: ", callers), F.lit("# ---"))
    return F.concat_ws("\n", head, part("", doc), part("", source))


def heading_slug(title: Column) -> Column:
    """Lower-case letters and digits joined by hyphens; 'section' if there are none."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "section").otherwise(slug)


def folded_card(name: Column) -> Column:
    """A card's name as its symbol's."""
    return F.regexp_replace(name, f"{CARD_SUFFIX}$", "")


def python_name(name: Column) -> Column:
    """A distribution's name as its import name."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "[-_.]+", "_"), "^_+|_+$", ""))


def cross_repo_name(slug: Column, name: Column) -> Column:
    return F.concat(slug, F.lit("::"), name)


def is_cross_repo(name: Column) -> Column:
    return name.contains("::")


def summary_name(repo: Column, module: Column, kind: Column) -> Column:
    return F.concat(repo, F.lit("."), module, F.lit("::"), kind, F.lit("::summary"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading parts two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))


def import_distance(candidate: Column, caller: Column) -> Column:
    """Parts of the longer name beyond the shared prefix; one less under the same parent package."""
    a, b = F.split(candidate, r"\."), F.split(caller, r"\.")
    base = F.greatest(F.size(a), F.size(b)) - common_prefix(a, b)
    parent = F.regexp_replace(caller, r"\.[^.]*$", "")
    sibling = caller.contains(".") & candidate.startswith(F.concat(parent, F.lit(".")))
    return F.when(sibling, base - 1).otherwise(base)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def capped_snippet(text: Column, most: int) -> Column:
    """The text up to the last line end within ``most`` characters."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(head)


def role_prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def permutation(answer: Column, n: Column) -> Column:
    """Order said by '[3] > [1]': 1-based places, repeats and places beyond n left out, missing ones
    appended in order."""
    said = F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")), lambda i: (i >= 1) & (i <= n))
    said = F.array_distinct(said)
    return F.when(n > 0, F.concat(said, F.array_except(F.sequence(F.lit(1), n), said))).otherwise(F.array().cast("array<int>"))


def cleaned_query(text: Column) -> Column:
    """Generated query text without its fence, with one closing semicolon."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "`", ""), r"(?i)^\s*(cypher|sql)\b", ""))
    return F.when(plain.endswith(";"), plain).otherwise(F.concat(plain, F.lit(";")))


def requirement_name(text: Column) -> Column:
    """Distribution named by a requirement."""
    return F.regexp_extract(text, r"^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", 1)


def uncommented_json(text: Column) -> Column:
    """JSON without line and block comments; strings are kept as they are."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")


def path_alias(name: Column, aliases: dict[str, str]) -> Column:
    """An import's path by the first alias pattern it matches: a '*' in the pattern stands for what takes
    the target's '*'; null if none matches.  Patterns with several '*' match nothing."""
    out = F.lit(None).cast("string")
    for pattern, target in reversed(aliases.items()):
        head, star, tail = pattern.partition("*")
        if "*" in tail:
            continue
        if not star:
            out = F.when(name == pattern, target.replace("*", "", 1)).otherwise(out)
            continue
        taken = F.substring(name, F.lit(len(head) + 1), F.length(name) - len(head) - len(tail))
        before, there, after = target.partition("*")
        fits = name.startswith(head) & name.endswith(tail) & (F.length(name) >= len(head) + len(tail))
        out = F.when(fits, F.concat(F.lit(before), taken, F.lit(after)) if there else F.lit(target)).otherwise(out)
    return out


def index_symbol(symbol: Column) -> Column:
    """Parts of a symbol of a code index: scheme, manager, package, version, descriptors.  Local ones have
    their number as the package; those of fewer parts are descriptors alone."""
    p = F.split(symbol, " ", 5)
    part = lambda i: F.get(p, F.lit(i))
    local, whole = symbol.startswith("local "), F.size(p) == 5
    some = lambda i: F.when(~local & whole, part(i))
    return F.struct(
        F.when(local, "local").otherwise(part(0)).alias("scheme"), some(1).alias("manager"), F.when(local, F.expr("cast(null as string)")).otherwise(some(2)).alias("package"), some(3).alias("version"),
        F.when(local, "").when(whole, part(4)).otherwise(symbol).alias("descriptors"),
    )


# Bits of the roles of an occurrence.
INDEX_ROLES = (("definition", 1), ("import", 2), ("write", 4), ("read", 8), ("generated", 16), ("test", 32))


def index_roles(bits: Column) -> Column:
    """Names of an occurrence's roles; a reference if it has none."""
    named = F.array_compact(F.array(*[F.when(bits.bitwiseAND(b) != 0, n) for n, b in INDEX_ROLES]))
    return F.when(F.size(named) == 0, F.array(F.lit("reference"))).otherwise(named)


def context_prefix(cached: Column, path: Column) -> Column:
    """A cached contextual prefix, or the path."""
    return F.coalesce(cached, F.concat(F.lit("[from "), path, F.lit("]")))


def iso_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")
