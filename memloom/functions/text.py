"""Text analytics as columns: tokens, sentences, quality gate, edge types, entities, intent."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and thresholds that results depend on.
STOPWORDS = "a an and are as at be by for from has have he her him his i in is it its of on or our she that the their them they this to was we were what which who will with you your".split()
TEMPLATES = ["I don't have access", "let me clarify", "sure, i can help", "as an ai language model", "i'm sorry, i cannot", "could you provide more details", "i am claude", "i am an ai assistant", "you are a helpful, harmless", "i cannot provide medical, legal", "user is a google engineer", "user prefers vim"]
ARTIFACT_SOURCES = ["recall_artifact", "agent_self_recall", "memory_dump"]
BULK_SOURCES = ["bulk_document", "document", "corpus", "ingest"]
QUALITY = 0.4
EDGE_PATTERNS = {
    "contradicts": [r"\b(but|however|on the contrary|actually|in fact)\b", r"\b(no|not|never|n't)\b", r"\b(wrong|incorrect|false)\b"],
    "corrects": [r"\b(correction|to clarify|let me correct|actually)\b", r"\b(should be|meant to say|i meant)\b"],
    "pivots": [r"\b(switched to|moved to|migrated to|changed to|instead of)\b", r"\b(pivot|shift|transition)\b"],
    "superseded": [r"\b(deprecated|outdated|superseded|no longer|replaced)\b"],
    "temporal_next": [r"\b(then|after that|next|subsequently|following|later)\b", r"\b(\d+ (?:days?|weeks?|months?) (?:later|after))\b"],
    "agrees": [r"\b(yes|exactly|correct|right|agreed|confirmed|same)\b"],
    "supports": [r"\b(because|since|as|due to|results in|leads to|causes)\b", r"\b(supports|reinforces|implies|entails)\b"],
}
BIO_PATTERNS = [
    r"\bis\s+(?:a|an|the)\s+\w+\s+(engineer|developer|manager|designer|scientist|researcher|founder|CEO|CTO|CFO|VP|director|analyst|consultant|architect|programmer|lead|head)\b",
    r"\b(?:at|works\s+(?:at|for)|employed\s+(?:at|by))\s+(Google|Meta|Apple|Microsoft|Amazon|OpenAI|Anthropic|Tesla|Netflix|Stripe|Uber|Airbnb|Spotify|Twitter|X|LinkedIn|Salesforce|Oracle|IBM|Intel|NVIDIA|AMD)\b",
    r"\b(?:based\s+in|lives?\s+in|located\s+in|from|in)\s+(San\s+Francisco|New\s+York|London|Seattle|Boston|Austin|Berlin|Paris|Tokyo|Beijing|Shanghai|Singapore|Mumbai|Bangalore|Toronto|Dublin|Amsterdam|Stockholm|Helsinki|Sydney|Melbourne)\b",
    r"\bage\s+\d{1,3}\b|\b\d{2}\s+years?\s+old\b",
    r"^User\s+[A-Z][a-z]+\s+[A-Z][a-z]+\s+is\b|^[A-Z][a-z]+\s+[A-Z][a-z]+\s+is\s+(?:a|an|the)\b",
]
ROUTE_DIRECTIONAL = ["why", "what caused", "what causes", "because", "reason", "led to", "what comes after", "consequence", "due to", "resulted in", "follows from"]
ROUTE_FACTUAL = ["what is", "what's", "who is", "where is", "when did", "when was", "how many", "describe", "find", "locate", "were ", "was ", "did ", "do ", "does ", "is the ", "are the ", "are ", "which magazine", "which film", "which company", "which one", "which of", "who directed", "who wrote", "who founded", "who played", "what year", "what city", "what country", "what nationality", "tell me", "show me", "give me"]
INTENT_DIRECTIONAL = ["why", "what caused", "what causes", "because", "reason", "what led to", "what comes after", "what happens next", "consequence", "due to", "resulted", "led to", "follow", "succeed"]
INTENT_SYMMETRIC = ["what is", "what's", "describe", "explain", "tell me about", "find", "locate"]
ENTITY = r"\b[A-Z][a-zA-Z'-]+(?:\s+(?:of|and|the|de|von|van|la|le|du|der)\s+[A-Z][a-zA-Z'-]+)*(?:\s+[A-Z][a-zA-Z'-]+){0,3}\b"
ENTITY_PREFIXES = "The A An This That Which What Who Where When Why How".split()
ENTITY_STOPWORDS = "the a an of in on at to for with by from is was were are be been this that these those which what who where when why how".split()
ROLE_CUES = [("decision", ["decided", "switched to", "we will use"]), ("attempt", ["tried", "attempted"]), ("pivot", ["but", "however", "instead"]), ("outcome", ["works", "stable", "succeeded", "failed"]), ("correction", ["actually", "correction", "wrong"])]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def raw_turn(user: Column, agent: Column) -> Column:
    return F.trim(F.concat(user, F.lit(" | AGENT: "), agent))


def text_hash(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def canonical_map(m: Column) -> Column:
    """JSON of a map with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits of two or more, without stopwords."""
    return F.array_distinct(F.filter(terms(text), lambda t: ~t.isin(*STOPWORDS)))


def terms(text: Column) -> Column:
    """The same with duplicates and stopwords."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)


def squash(text: Column) -> Column:
    """Lower-case letters, digits and underscores of any script, runs of all else as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def unique_ratio(text: Column) -> Column:
    w = words(text)
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def paragraphs(body: Column, least: int = 20) -> Column:
    """What stands between two line ends, stripped; shorter pieces than ``least`` characters go."""
    return F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: F.length(p) >= least)


def chunks(body: Column, least: int = 30, full: int = 800) -> Column:
    """Stripped paragraphs of more than ``least`` characters, joined by blank lines; a chunk ends with the paragraph
    that takes it beyond ``full`` characters."""
    kept = F.filter(F.transform(F.split(body, "\n\n"), strip), lambda p: F.length(p) > least)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        now, n = F.concat(acc["now"], F.array(p)), acc["n"] + F.length(p)
        done = F.when(n > full, F.concat(acc["done"], F.array(F.array_join(now, "\n\n")))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(n > full, F.array().cast("array<string>")).otherwise(now).alias("now"), F.when(n > full, 0).otherwise(n).alias("n"))

    return F.aggregate(kept, start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["now"], "\n\n")))).otherwise(acc["done"]))


def thoughts(text: Column, least: int = 5) -> Column:
    """(sentence, role) of each sentence of at least ``least`` characters."""
    parts = F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip), lambda s: F.length(s) >= least)
    return F.transform(parts, lambda s: F.struct(s.alias("sentence"), role(s).alias("role")))


def sentences(text: Column, min_tokens: int = 3) -> Column:
    """Trimmed sentences of at least ``min_tokens`` words."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.size(words(s)) >= min_tokens)


def has_any(text: Column, cues: list[str]) -> Column:
    """Plain substrings of the lower-cased text, also inside words."""
    low = F.lower(text)
    return functools.reduce(operator.or_, [F.contains(low, F.lit(c)) for c in cues])


def matches(text: Column, patterns: list[str]) -> Column:
    return functools.reduce(operator.or_, [text.rlike(f"(?i){p}") for p in patterns])


def bio_attributes(text: Column) -> Column:
    return functools.reduce(operator.add, [text.rlike(f"(?i){p}").cast("int") for p in BIO_PATTERNS])


def anchors(text: Column, buffer: Column) -> Column:
    """Distinct capitalised words of the text that occur in the buffer as substrings."""
    return F.size(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}\b"), 0)), lambda w: F.contains(buffer, w)))


def quality_score(text: Column, buffer: Column | None = None) -> Column:
    """The gate's cascade; ``buffer`` is the joined conversation before the text (null, empty or none: no bio
    check)."""
    body, n, u = F.trim(text), F.size(words(text)), unique_ratio(F.lower(text))
    template = functools.reduce(operator.or_, [F.contains(F.lower(body), F.lit(t.lower())) for t in TEMPLATES])
    score = F.when(body.isNull() | (body == ""), 0.0).when(F.length(body) < 10, 0.05).when(template, 0.1)
    if buffer is not None:
        score = score.when((F.length(buffer) > 0) & (bio_attributes(body) >= 3) & (anchors(body, buffer) < 2), 0.05)
    full = F.greatest(F.lit(0.5), F.least(F.lit(1.0), 0.4 + 0.5 * F.least(F.lit(1.0), n / 30) + 0.2 * u))
    return score.when(n < 3, 0.15).when(u < 0.4, 0.2).otherwise(full)


def quality_status(score: Column) -> Column:
    return F.when(score < QUALITY, "rejected").otherwise("pending")


def edge_type(src: Column, dst: Column, g: Column, anti: Column) -> Column:
    """The ordered rules by which a pair of texts and its scores get a type."""
    both = F.concat_ws(" ", F.coalesce(src, F.lit("")), F.coalesce(dst, F.lit("")))
    hit = lambda kind, where=both: matches(where, EDGE_PATTERNS[kind])
    strong = F.coalesce(F.abs(anti) > 0.1, F.lit(False))
    return (
        F.when(hit("corrects", F.coalesce(dst, F.lit(""))), "corrects").when(hit("superseded") & (g < 0), "superseded").when(hit("contradicts") & (g < 0.05), "contradicts")
        .when(hit("pivots"), "pivots").when(hit("temporal_next"), "temporal_next").when(strong & (g > 0), "supports").when(strong, "contradicts")
        .when(hit("agrees") & (g > 0), "agrees").when(hit("supports") & (g > 0), "supports").when(g > 0.1, "agrees").when(g < -0.05, "contradicts").otherwise("pending")
    )


def entities(text: Column, min_chars: int = 3, most: int = 12) -> Column:
    """Capitalised phrases without a leading function word, distinct by lower case, the longest first."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), 0)
    found = F.transform(found, lambda e: F.trim(F.regexp_replace(e, f"^({'|'.join(ENTITY_PREFIXES)}) ", "")))
    kept = F.filter(found, lambda e: (F.length(e) >= min_chars) & F.exists(words(e), lambda w: ~F.lower(w).isin(*ENTITY_STOPWORDS)))
    first = F.filter(kept, lambda e, k: F.array_position(F.transform(kept, F.lower), F.lower(e)) == k + 1)
    ranked = F.transform(first, lambda e, k: F.struct((-F.length(e)).alias("n"), k.alias("k"), e.alias("e")))
    return F.slice(F.transform(F.array_sort(ranked), lambda x: x.e), 1, most)


def claims(text: Column) -> Column:
    return F.filter(sentences(text, 4), lambda s: ~F.endswith(s, F.lit("?")))


def coverage(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' tokens that the premise holds; null for none."""
    h = tokens(hypothesis)
    return F.when(F.size(h) > 0, F.size(F.array_intersect(tokens(premise), h)) / F.size(h))


def lexical_entails(premise: Column, hypothesis: Column, share: float = 0.6) -> Column:
    return F.coalesce(coverage(premise, hypothesis) >= share, F.lit(False))


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """The n-grams of characters of each lower-case word with a space at either end, with duplicates; a word that is
    no longer than n with its spaces is one n-gram, and has no longer ones."""
    padded = F.transform(words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: (n == least) | (n <= F.length(w)))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda k: F.substring(w, k, n))))

    return F.flatten(F.transform(padded, of))


def tfidf_cosine(one: Column, two: Column) -> Column:
    """Cosine of the two texts' character n-grams, weighted as if the two were all documents: an n-gram of one text
    alone counts 1 + ln 1.5 times. 0 where a text has none."""
    side = lambda text, k: F.transform(char_grams(text), lambda g: F.struct(g.alias("g"), F.lit(k).alias("k")))
    ordered = F.array_sort(F.concat(side(one, 0), side(two, 1)))
    rare = (1 + math.log(1.5)) ** 2
    zero = F.lit(0.0)

    def closed(s: Column) -> Column:
        """The sums with the n-gram that has just been counted."""
        weight = F.when((s["x"] > 0) & (s["y"] > 0), 1.0).otherwise(rare)
        return F.struct((s["p"] + s["x"] * s["y"] * weight).alias("p"), (s["q"] + s["x"] * s["x"] * weight).alias("q"), (s["r"] + s["y"] * s["y"] * weight).alias("r"))

    def step(s: Column, e: Column) -> Column:
        new, done = s["g"] != e["g"], closed(s)
        keep = lambda c: F.when(new, done[c]).otherwise(s[c]).alias(c)
        count = lambda c, k: (F.when(new, zero).otherwise(s[c]) + F.when(e["k"] == k, 1.0).otherwise(0.0)).alias(c)
        return F.struct(e["g"].alias("g"), count("x", 0), count("y", 1), keep("p"), keep("q"), keep("r"))

    start = F.struct(F.lit("").alias("g"), *(zero.alias(c) for c in "xypqr"))
    sums = F.aggregate(ordered, start, step, closed)
    return F.transform(F.array(sums), lambda s: F.when((s.q > 0) & (s.r > 0), s.p / F.sqrt(s.q * s.r)).otherwise(zero))[0]


def tfidf_entails(premise: Column, hypothesis: Column, least: float = 0.4) -> Column:
    return F.coalesce(tfidf_cosine(premise, hypothesis) >= least, F.lit(False))


def intent(query: Column) -> Column:
    d, s = has_any(query, INTENT_DIRECTIONAL), has_any(query, INTENT_SYMMETRIC)
    return F.when(d & ~s, "directional").when(s & ~d, "symmetric").otherwise("hybrid")


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def fact_matches(answer: Column, gold: Column) -> Column:
    """Whether the answer holds the gold text, whatever the case."""
    return F.contains(F.lower(answer), F.lower(gold))


def overlaps(one: Column, two: Column, share: float = 0.4) -> Column:
    """Whether more than ``share`` of the first text's tokens are in the second."""
    a = tokens(one)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, tokens(two))), F.size(a)) > share, F.lit(False))


def category(text: Column, lists: list[tuple[str, list[str]]]) -> Column:
    """The name of the first list of which the text holds a member."""
    out = F.when(F.lit(False), "unknown")
    for name, cues in lists:
        out = out.when(has_any(text, [c.lower() for c in cues]), name)
    return out.otherwise("unknown")


def spans_of(text: Column, answer: Column) -> Column:
    """A model's spans (an array of texts), or the text's sentences where it gave none."""
    return F.when(F.size(answer) > 0, answer).otherwise(sentences(text))


def rubric_score(text: Column, answer: Column, buffer: Column) -> Column:
    """The gate by a model's answer, a JSON object with a score between 0 and 1; made-up biographies are turned down
    before (an empty buffer counts), and an answer that can't be read leaves it to :func:`quality_score`."""
    said = F.get_json_object(answer, "$.score").try_cast("double")
    return F.when(is_fabricated_bio(text, buffer), 0.05).when(said.between(0.0, 1.0), said).otherwise(quality_score(text, buffer))


def role(sentence: Column) -> Column:
    out = F.when(F.lit(False), "fact")
    for name, cues in ROLE_CUES:
        out = out.when(has_any(sentence, cues), name)
    return out.otherwise("fact")


def pack(spans: Column, least: int = 80, most: int = 250) -> Column:
    """Adjacent spans joined by a space into chunks: one ends when it has ``least`` words and the next span would
    take it beyond ``most``. A longer single span stays whole; chunks below three words go."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(acc: Column, span: Column) -> Column:
        k = F.size(words(span))
        full = (acc["n"] >= least) & (acc["n"] + k > most)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(full | (acc["n"] == 0), span).otherwise(F.concat(acc["now"], F.lit(" "), span))
        return F.struct(done.alias("done"), now.alias("now"), F.when(full, k).otherwise(acc["n"] + k).alias("n"))

    chunks = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.filter(chunks, lambda c: F.size(words(c)) >= 3)


def support_tag(answer: Column) -> Column:
    """Score of a checker's last bracketed verdict; null where there is none."""
    tags = F.regexp_extract_all(answer, F.lit(r"(?i)\[(Supported|Not Supported|Irrelevant)\]"), 1)
    last = F.lower(F.try_element_at(tags, F.lit(-1)))
    return F.when(last.startswith("not"), 0.10).when(last == "irrelevant", 0.05).when(last.isNotNull(), 0.85)


def is_fabricated_bio(text: Column, buffer: Column) -> Column:
    """Three kinds of personal attributes or more, with fewer than two names that the buffer holds."""
    return (bio_attributes(text) >= 3) & (anchors(text, buffer) < 2)
