"""Scalar functions of the evidence graph as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme of the graph's addresses.
SCHEME = "evi"

# Literals that are too common for an exact match to mean anything.
COMMON_VALUES = ["0", "1", "2", "3", "4", "5", "10", "100", "1000", "0.0", "0.1", "0.5", "1.0", "2.0", "0.9", "0.99"]
# Words that a component's name tokens leave out.
STOP_WORDS = ["the", "a", "an", "of", "for", "and", "with", "our", "we", "using", "based", "to", "on", "in", "is", "are", "from", "by", "efficient", "selecting", "creating", "sufficiently", "large", "choosing"]
# Words too general to claim that a component is absent.
GENERIC_WORDS = [
    "architecture", "network", "model", "module", "procedure", "method", "overall", "block", "layer", "net", "part", "branch", "component", "framework", "pipeline", "stage", "details", "implementation",
    "inference", "training", "testing", "evaluation", "optimization", "optimisation", "preprocessing", "postprocessing", "results", "experiments", "discussion", "conclusion", "introduction", "setup",
]
# Words that say nothing of a paper's subject.
GENERIC_TOPICS = ["net", "network", "networks", "official", "implementation", "code", "pytorch", "tensorflow", "model", "models", "deep", "learning", "the", "for", "and", "with", "using", "based", "3d", "2d", "a", "an", "of", "in", "on", "to", "via"]
# Fixed value: words of a reported result.
RESULT_HINT = r"(?i)accuracy|bleu|f1\b|mAP\b|precision|recall|score|percent|%|outperform|achieve|state-of-the-art|human"
# Section titles to component kinds, the first that fits counts.
TITLE_KINDS = [
    ("loss", r"\bloss(es)?\b|\bobjective\b|\bcriterion\b"),
    ("architecture", r"\barchitectur|\bmodel\b|\bnetwork\b|\bencoder\b|\bdecoder\b"),
    ("optimizer", r"\boptimi[sz]|\blearning rate\b|\bschedule\b"),
    ("dataset", r"\bdataset(s)?\b|\bcorpus\b|\bdata collection\b"),
    ("preprocessing", r"\bpre-?process|\baugmentation\b|\btokeni[sz]"),
    ("training", r"\btrain(ing)?\b|\bpre-?train"),
    ("inference", r"\binference\b|\bdecoding\b|\bzero-?shot\b|\bprediction\b"),
    ("evaluation", r"\bevaluat|\bexperiment|\bbenchmark|\bresults?\b|\bablation"),
    ("module", r"\bapproach\b|\bmethod\b|\bcomponent\b|\bmodule\b"),
]
CONFIDENCE = ["UNKNOWN", "POSSIBLE", "LIKELY", "CONFIRMED"]

_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def slugify(text: Column, length: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, length)
    return F.when(cut == "", "untitled").otherwise(cut)


def math_form(latex: Column) -> Column:
    """Math without labels, tags and number switches, white space collapsed."""
    bare = F.regexp_replace(latex, r"\\(label|tag|nonumber|notag)\*?(\{[^}]*\})?", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def content_hash(latex: Column) -> Column:
    return F.substring(F.sha2(math_form(latex), 256), 1, 12)


def evidence_id(kind: Column, uri: Column, locator: Column, excerpt: Column) -> Column:
    """Content address of evidence; null parts print as None."""
    text = F.concat_ws("|", kind, uri, F.coalesce(locator, F.lit("None")), F.coalesce(excerpt, F.lit("None")))
    return F.concat(F.lit("ev:"), F.substring(F.sha2(text, 256), 1, 16))


def absence_ref(repo: Column, query: Column, method: Column, salt: Column | None = None) -> Column:
    text = F.concat_ws("|", repo, query, method, salt if salt is not None else F.lit(""))
    return F.concat(F.lit("absent:"), F.substring(F.sha2(text, 256), 1, 12))


def claim_id(paper_version: Column, statement: Column) -> Column:
    """Name-based UUID of the statement in the URL name space, first 12 digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(statement, "utf-8")))
    return F.concat(paper_version, F.lit(":claim:"), F.substring(digest, 1, 12))


def encode_segment(text: Column) -> Column:
    """Percent-encoding in which only letters, digits and _.-~ stay."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def paper_uri(paper: Column, *rest: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{SCHEME}://paper"), encode_segment(paper), *rest)


def repo_uri(repo: Column, *rest: Column) -> Column:
    return F.concat_ws("/", F.lit(f"{SCHEME}://repo"), repo, *rest)


def symbol_uri(repo: Column, qualified_name: Column) -> Column:
    return repo_uri(repo, F.lit("symbol"), encode_segment(qualified_name))


def base_id(paper_version: Column) -> Column:
    return F.regexp_replace(paper_version, r"v\d+$", "")


def _first(*found: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def arxiv_parts(text: Column) -> tuple[Column, Column]:
    """(id, version) in a preprint address, a bare or prefixed id, or its DOI; null if there is none."""
    number = r"(\d{4}\.\d{4,5})(?:v(\d+))?"
    patterns = [rf"(?i)arxiv\.org/(?:abs|pdf|e-print)/{number}", rf"(?i)^\s*(?:arxiv:)?{number}\s*$", rf"(?i)10\.48550/arxiv\.{number}"]
    id_ = _first(*(F.regexp_extract(text, p, 1) for p in patterns))
    version = F.lit(None).cast("string")
    for p in reversed(patterns):
        version = F.when(text.rlike(p), F.nullif(F.regexp_extract(text, p, 2), F.lit(""))).otherwise(version)
    return id_, version.cast("int")


def doi_of(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^https?://(dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    found = F.regexp_extract(bare, r"(?i)\b(10\.\d{4,9}/[^\s\"'<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;)]+$", ""), F.lit(""))


def repo_parts(text: Column) -> tuple[Column, Column]:
    pattern = r"^(?:https?://github\.com/)?([A-Za-z0-9_.\-]+)/([A-Za-z0-9_.\-]+?)(?:\.git)?/?$"
    return tuple(_first(F.regexp_extract(F.trim(text), pattern, i)) for i in (1, 2))


def mentions_arxiv(text: Column, arxiv_id: Column) -> Column:
    """Whether some preprint number in a text holds the id."""
    text = F.coalesce(text, F.lit(""))
    return F.contains(text, arxiv_id) & F.exists(F.regexp_extract_all(text, F.lit(r"(?i)arxiv(?:\.org/(?:abs|pdf)/|[:\s]*)(\d{4}\.\d{4,5})"), F.lit(1)), lambda x: F.contains(x, arxiv_id))


def name_tokens(text: Column) -> Column:
    """Words of a name of over two characters without stop words, then the joined forms of hyphenated words that are new."""
    low = F.lower(text)
    words = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))
    hyphened = F.transform(F.filter(F.split(F.trim(low), r"\s+"), lambda t: F.contains(t, F.lit("-"))), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    return F.concat(words, F.array_except(F.filter(hyphened, lambda t: F.length(t) > 2), words))


def prefix_stem(token: Column) -> Column:
    return F.when(F.length(token) > 5, F.substring(token, 1, 5)).otherwise(token)


def verb_form(token: Column) -> Column:
    """The verb of an agent noun of at least four letters before its ending; else null."""
    base = F.regexp_extract(token, "^(.*[a-z])(?:er|or)$", 1)
    return F.when(F.length(base) >= 4, F.when(base.endswith("e"), base).otherwise(F.concat(base, F.lit("e"))))


def distinctive_value(value: Column) -> Column:
    return ~F.trim(value).isin(COMMON_VALUES)


def looks_like_result(symbol: Column, context: Column) -> Column:
    return F.concat(F.coalesce(symbol, F.lit("")), F.lit(" "), F.substring(F.coalesce(context, F.lit("")), 1, 160)).rlike(RESULT_HINT)


def named_quantity(symbol: Column) -> Column:
    """A name of one word."""
    return F.coalesce(F.trim(symbol).rlike(r"^\S+$"), F.lit(False))


def kind_of_title(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(TITLE_KINDS):
        out = F.when(title.rlike("(?i)" + pattern), kind).otherwise(out)
    return out


def strip_comments(text: Column) -> Column:
    """Each line up to its first percent sign that isn't escaped."""
    return F.regexp_replace(text, r"(?md)^((?:[^%\\\n]++|\\.)*+)%.*$", "$1")


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1


def confidence_code(level: Column) -> Column:
    return F.array_position(strings(CONFIDENCE), level).cast("int") - 1


def at_most(level: Column, ceiling: Column) -> Column:
    return F.when(confidence_code(level) <= confidence_code(ceiling), level).otherwise(ceiling)


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def name_affinity(repo_name: Column, title: Column) -> Column:
    """Whether a repository's name and the head of a title, before a colon, hold one another."""
    return affine(alnum(repo_name), title_head(title))


def title_head(title: Column) -> Column:
    return alnum(F.substring_index(title, ":", 1))


def affine(name: Column, head: Column) -> Column:
    return (F.length(name) >= 3) & (head != "") & (F.contains(head, name) | F.contains(name, head))


def topic_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(GENERIC_TOPICS)))


def title_topics(title: Column) -> Column:
    """Topics of a title but the method's own name."""
    return F.array_except(topic_tokens(title), topic_tokens(F.substring_index(title, ":", 1)))


def described_topics(description: Column) -> Column:
    """Topics of a description; null if there is none."""
    return F.when(F.coalesce(description, F.lit("")) != "", topic_tokens(description))


def topics_apart(described: Column, topics: Column) -> Column:
    return F.coalesce(~F.arrays_overlap(described, topics), F.lit(False))


def description_contradicts(description: Column, title: Column) -> Column:
    """A description that shares no topic with the title but the method's own name."""
    return topics_apart(described_topics(description), title_topics(title))


def person_tokens(names: Column) -> Column:
    """Parts of over two characters of an array of names."""
    parts = F.flatten(F.transform(names, lambda n: F.split(F.lower(F.coalesce(n, F.lit(""))), r"[\s.\-]+")))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 2))


def owner_parts(owner: Column, owner_name: Column) -> Column:
    """Parts of an owner's names, short and repeated ones too: to be intersected with person_tokens, which have neither."""
    return F.split(F.lower(F.concat_ws(" ", owner, F.coalesce(owner_name, F.lit("")))), r"[\s.\-_]+")


def curated_list(name: Column, description: Column, code_files: Column) -> Column:
    """A repository without code, or called a list of papers."""
    # Names and descriptions of lists.
    by_name = r"(?i)awesome|paper[-_ ]?list|reading[-_ ]?list|survey|collection|resources|bibliograph"
    by_text = r"(?i)curated list|list of papers|paper list|collection of|reading list|survey of"
    return (code_files == 0) | name.rlike(by_name) | F.coalesce(description.rlike(by_text), F.lit(False))


def is_code_file(path: Column) -> Column:
    # Source extensions, and directories that hold none.
    extensions = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".cu", ".m", ".swift", ".kt", ".scala", ".rb", ".jl", ".lua", ".sh"]
    elsewhere = r"(?i)(^|/)(docs?|examples?|assets?|images?|paper_list|website|blog|\.github)(/|$)"
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)).isin(extensions) & ~path.rlike(elsewhere)


def is_config_source(path: Column) -> Column:
    # Suffixes of files that may hold settings, and directories of data.
    suffixes = r"\.(py|cpp|cc|h|hpp|cu|js|ts|java|go|rs|yaml|yml|cfg|ini|toml)$"
    data = r"(?i)(^|/)(data|datasets?|assets?|preprocess|annotations?|calib\w*|checkpoints?)(/|$)"
    return path.rlike(suffixes) & ~path.rlike(data)
