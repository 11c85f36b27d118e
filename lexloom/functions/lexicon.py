"""Default word lists; every operator takes its own instead."""

from __future__ import annotations

# Fixed values.
CONCEPTS = {
    "liability": ["negligence", "strict liability", "vicarious liability", "product liability"],
    "contract": ["breach", "consideration", "offer", "acceptance", "damages", "specific performance"],
    "criminal": ["mens rea", "actus reus", "intent", "malice", "premeditation"],
    "procedure": ["jurisdiction", "standing", "statute of limitations", "res judicata"],
    "evidence": ["hearsay", "relevance", "privilege", "burden of proof", "admissibility"],
    "constitutional": ["due process", "equal protection", "free speech", "search and seizure"],
}
INTENTS = {
    "precedent": ["case", "precedent", "ruling", "held", "decision"],
    "statute_interpretation": ["statute", "section", "interpretation", "meaning", "definition"],
    "factual": ["what happened", "facts", "circumstances", "events"],
    "procedure": ["how to", "procedure", "process", "filing", "requirements"],
    "comparison": ["difference", "compare", "versus", "distinguish"],
}
TIERS = {
    3.0: ["verdict", "judgment", "ruling", "held", "ordered", "convicted", "acquitted", "liable", "damages", "injunction"],
    2.0: ["plaintiff", "defendant", "court", "appeal", "evidence", "testimony", "witness", "statute", "precedent", "jurisdiction"],
    1.0: ["whereas", "pursuant", "herein", "thereof", "hereby"],
}
KEYWORDS = ["plaintiff", "defendant", "appellant", "respondent", "court", "judgment", "order", "section", "article", "clause", "provision", "held", "ruled", "decided", "appeal", "petition", "writ"]
SECTION_WEIGHTS = {"holding": 2.0, "conclusion": 1.8, "reasoning": 1.5, "facts": 1.2, "dissent": 0.8}
FUSION_WEIGHTS = {"dense": 0.35, "bm25": 0.25, "entity": 0.25, "graph": 0.15}
SENTENCE_WEIGHTS = {"position": 0.15, "tfidf": 0.25, "semantic": 0.35, "lexicon": 0.25}

# Our own, for TF-IDF: frequent words without content.
STOP_WORDS = "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its may more most no not of on one only or other our she should so some such than that the their them then there these they this to was we were what when where which who will with would you your".split()


def concept_terms(concepts: dict[str, list[str]] = CONCEPTS) -> list[str]:
    return [t for terms in concepts.values() for t in terms]
