"""Rules and their phrases, as data.

Each phrase has its place in its rule's list, which decides the order of violations; the table itself is kept in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

#: how phrases of a rule are matched: between word edges, anywhere, or only the first time in lower-cased text
BOUNDED, ANYWHERE, FIRST = "bounded", "anywhere", "first"


@dataclass(frozen=True)
class Rule:
    id: str
    order: int
    severity: str
    advice: str
    mode: str | None = None
    context: int = 10


RULES = {
    r.id: r
    for r in (
        Rule("punct.em_dash", 1, "critical", "use a comma or a full stop for the dash", context=15),
        Rule("punct.semicolon", 2, "medium", "make two sentences of it", context=15),
        Rule("punct.colon_overuse", 3, "medium", "join both parts without a colon", context=15),
        Rule("struct.not_x_but_y", 4, "high", "say what it is, not what it isn't"),
        Rule("struct.triple_parallel", 5, "high", "two items do, or uneven ones", context=5),
        Rule("struct.abstract_noun_stack", 6, "high", "name a thing or a person instead"),
        Rule("struct.tailing_negation", 7, "medium", "drop the negation at the end"),
        Rule("vocab.high_risk_transition", 8, "high", "begin without a connective", BOUNDED),
        Rule("vocab.cliche_phrase", 9, "medium", "put it in words of your own", ANYWHERE),
        Rule("vocab.ai_filler", 10, "low", "choose a plainer word", BOUNDED),
        Rule("content.significance_inflation", 11, "high", "tell what happened, not how important it was", ANYWHERE),
        Rule("content.promotional", 12, "medium", "describe it soberly", BOUNDED),
        Rule("content.superficial_ing", 13, "high", "end the sentence before the participle"),
        Rule("artifact.chatbot", 14, "critical", "delete the remark to the user", FIRST, 5),
        Rule("artifact.knowledge_cutoff", 15, "critical", "delete the disclaimer", FIRST, 5),
        Rule("style.copula_avoidance", 16, "medium", "write is or has", BOUNDED),
        Rule("style.generic_conclusion", 17, "medium", "end on a fact", FIRST, 5),
        Rule("style.persuasive_trope", 18, "medium", "come to the point at once", FIRST, 5),
        Rule("style.signposting", 19, "medium", "begin with the matter itself", FIRST, 5),
        Rule("syntax.uniform_rhythm", 20, "medium", "put a short sentence between"),
        Rule("syntax.passive_stack", 21, "medium", "let somebody act"),
        Rule("human.no_colloquial", 22, "low", "allow a spoken word or two"),
        Rule("human.no_short_sentence", 23, "low", "write one sentence of eight words at most"),
        Rule("human.no_question", 24, "low", "ask the reader something"),
    )
}

_TABLE = {
    "vocab.high_risk_transition": {"fundamentally": 6, "furthermore": 2, "however": 1, "in essence": 5, "indeed": 8, "moreover": 3, "notably": 9, "that said": 4, "ultimately": 7},
    "vocab.cliche_phrase": {
        "a nuanced approach": 9, "at its core": 10, "at this point in time": 15, "by default": 3, "constructed metric": 7, "due to the fact that": 14, "empirical foundation": 8,
        "fresh in everyone's memory": 1, "fresh in memory": 2, "has the ability to": 16, "in order to": 13, "in practice": 6, "in the event that": 17, "navigate the complexities": 12,
        "navigate the complexities of": 11, "there wasn't much to go on": 4, "walked away feeling": 5,
    },
    "vocab.ai_filler": {
        "align with": 19, "comprehensive": 6, "delve": 2, "delve into": 1, "enduring": 13, "enhance": 20, "garner": 14, "in conclusion": 11, "in today's world": 10, "interplay": 15, "intricacies": 17,
        "intricate": 16, "it is important to": 9, "it is worth noting": 8, "it's crucial": 12, "multifaceted": 4, "nuanced": 3, "pivotal": 5, "tapestry": 18,
    },
    "content.significance_inflation": {
        "crucial role": 6, "deeply rooted": 10, "evolving landscape": 15, "focal point": 16, "highlights its significance": 18, "indelible mark": 9, "is a testament": 3, "key turning point": 8,
        "marking a pivotal": 12, "marks a shift": 22, "pivotal moment": 4, "pivotal role": 5, "reflects broader": 14, "represents a shift": 21, "serves as a testament": 2, "setting the stage for": 11,
        "shaping the future": 13, "stands as a testament": 1, "symbolizing its enduring": 20, "symbolizing its ongoing": 19, "underscores its importance": 17, "vital role": 7,
    },
    "content.promotional": {
        "breathtaking": 3, "commitment to excellence": 11, "exemplifies": 12, "groundbreaking": 4, "in the heart of": 8, "must-visit": 6, "natural beauty": 9, "nestled": 2, "renowned": 5,
        "rich cultural heritage": 10, "stunning": 7, "vibrant": 1,
    },
    "artifact.chatbot": {
        "certainly!": 5, "don't hesitate to": 11, "feel free to": 10, "great question": 4, "i hope this helps": 1, "let me know if there": 3, "let me know if you": 2, "of course!": 6,
        "that's an excellent point": 8, "would you like me to": 9, "you're absolutely right": 7,
    },
    "artifact.knowledge_cutoff": {
        "as of my knowledge cutoff": 6, "as of my last": 1, "based on available information": 5, "up to my last training": 2, "while specific details are limited": 3, "while specific details are scarce": 4,
    },
    "style.copula_avoidance": {"boasts a": 5, "features a": 6, "functions as": 3, "offers a": 7, "represents a": 4, "serves as": 1, "stands as": 2},
    "style.generic_conclusion": {
        "continues to thrive": 5, "exciting times lie ahead": 2, "journey toward excellence": 3, "paving the way for": 6, "step in the right direction": 4, "the future looks bright": 1,
    },
    "style.persuasive_trope": {"the deeper issue": 4, "the heart of the matter": 3, "the real question is": 1, "what really matters": 2},
    "style.signposting": {
        "here's what you need to know": 4, "let's break this down": 3, "let's dive in": 1, "let's explore": 2, "let's take a closer look": 7, "now let's look at": 5, "without further ado": 6,
    },
}

#: rule -> phrases in order
PHRASES = {rule: tuple(sorted(table, key=table.__getitem__)) for rule, table in _TABLE.items()}

ABSTRACT_NOUNS = tuple(
    sorted(
        "accountability alignment architecture capability complexity dimension discourse ecosystem effectiveness efficiency "
        "facilitation foundation framework functionality governance implementation implication infrastructure inherently integration "
        "intersection landscape legitimacy mechanism methodology narrative optimization outcomes paradigm prioritization "
        "productivity resilience stakeholder suboptimal sustainability synergy trajectory transformation transparency utilization".split()
    )
)
PARTICIPLES = tuple(sorted(["contributing to", *"cultivating emphasizing encompassing ensuring fostering highlighting reflecting showcasing symbolizing underscoring".split()]))
COLLOQUIAL = tuple(sorted(["a whole lot", "at least", "kind of", "pretty much", "sort of", "to be fair", *"actually honestly just really sure though well".split()]))
