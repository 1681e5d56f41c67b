"""Whether a message disputes something, by fixed cues in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues (text, label) of a lower-cased message that disputes a claim; the first that fits counts.
CUES = (
    ("you don't think", "disputes a conclusion"), ("you dont think", "disputes a conclusion"), ("don't you think", "disputes a conclusion"),
    ("i disagree", "explicit disagreement"),
    ("that's not right", "asserts the claim is wrong"), ("thats not right", "asserts the claim is wrong"), ("that's not true", "asserts the claim is wrong"),
    ("that's wrong", "asserts the claim is wrong"), ("you're wrong", "asserts the claim is wrong"), ("youre wrong", "asserts the claim is wrong"), ("that is incorrect", "asserts the claim is wrong"),
    ("are you sure", "doubts a claim"), ("are you certain", "doubts a claim"), ("you sure about", "doubts a claim"),
    ("double check", "asks for verification of a claim"), ("check again", "asks for verification of a claim"),
    ("you have told me that before", "cites a past claim that was wrong"), ("you told me that before", "cites a past claim that was wrong"),
    ("you said before", "cites a past claim"), ("but you said", "cites a past claim"), ("you previously said", "cites a past claim"), ("last time you said", "cites a past claim"),
    (", correct?", "asks the agent to confirm a stated fact"), (" correct?", "asks the agent to confirm a stated fact"), ("is that right?", "asks the agent to confirm a stated fact"), ("isn't it?", "asks the agent to confirm a stated fact"),
    ("if i'm wrong", "invites the agent to contradict them"), ("if im wrong", "invites the agent to contradict them"),
    ("you keep saying", "disputes a repeated claim"),
    ("give pushback", "pushes back on a claim"), ("some pushback", "pushes back on a claim"), ("pushback to", "pushes back on a claim"), ("pushback on", "pushes back on a claim"),
    ("pushback that", "pushes back on a claim"), ("push back on", "pushes back on a claim"), ("push back that", "pushes back on a claim"), ("want to push back", "pushes back on a claim"),
)
# The same for a limit that was stated or accepted; these come before the cues above.
LIMIT_CUES = (
    ("wrote off", "disputes a write-off"), ("write off", "disputes a write-off"), ("written off", "disputes a write-off"), ("writing off", "disputes a write-off"), ("wrote it off", "disputes a write-off"), ("write it off", "disputes a write-off"),
    ("doable than", "says it is doable"), ("more doable", "says it is doable"),
    ("honest limits", "disputes a stated limit"), ("limits you mentioned", "disputes a stated limit"), ("hard limit", "disputes a stated limit"), ("coded limit", "disputes a stated limit"),
    ("documented limitation", "disputes a stated limit"), ("documented engine limitation", "disputes a stated limit"),
    ("blindly believe", "refuses to accept a limit"), ("blindly accept", "refuses to accept a limit"), ("rather than accepting", "refuses to accept a limit"), ("instead of accepting", "refuses to accept a limit"),
    ("by default accepting", "refuses to accept a limit"), ("accepting the limit", "refuses to accept a limit"), ("accepting limits", "refuses to accept a limit"), ("settle for", "refuses to accept a limit"),
    ("we know we can", "cites evidence it can be done"), ("other games manage", "cites evidence it can be done"), ("other engines manage", "cites evidence it can be done"),
    ("other engines have", "cites evidence it can be done"), ("other games have", "cites evidence it can be done"), ("others have done", "cites evidence it can be done"),
    ("overcome", "asks to get past a limit"), ("overcoming", "asks to get past a limit"), ("break through", "asks to get past a limit"), ("get past", "asks to get past a limit"), ("push past", "asks to get past a limit"),
    ('research" says', "disputes a limit resting on authority"), ("what the research says", "disputes a limit resting on authority"), ("the research says", "disputes a limit resting on authority"),
    ("documentation says", "disputes a limit resting on authority"), ("experts say", "disputes a limit resting on authority"), ("consensus", "disputes a limit resting on authority"),
    ("most recent version", "questions whether a limit is current"), ("latest version", "questions whether a limit is current"), ("later version", "questions whether a limit is current"), ("newer version", "questions whether a limit is current"),
    ("wrong on the latest", "questions whether a limit is current"), ("beyond just meta documentation", "questions whether a limit is current"), ("beyond the documentation", "questions whether a limit is current"),
    ("there has to be a way", "insists there is a way"), ("must be a way", "insists there is a way"), ("sure there is a way", "insists there is a way"), ("know there is a way", "insists there is a way"),
    ("a way around", "insists there is a way"), ("i know we can", "insists there is a way"), ("together we can", "insists there is a way"),
)
# Emphasis as it was typed, words and phrases of limits, and their label.
EMPHASIS = ((" IS possible", "insists it is possible"), (" IS doable", "insists it is possible"), (" CAN ", "insists it is possible"), (" COULD ", "insists it is possible"))
LIMIT_WORDS = ("limit", "limits", "limitation", "limitations", "possible", "impossible", "doable", "feasible", "realistic", "capability", "capabilities", "research")
LIMIT_PHRASES = ("most recent", "most current", "latest", "is there not a way", "isn't there a way", "is there no way")
LIMIT_LABEL = "disputes a limit"


def _first(text: Column, cues: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(cue)), label) for cue, label in cues])


def about_limits(lower: Column) -> Column:
    words = F.arrays_overlap(F.split(lower, r"[^\p{L}\p{N}']+"), F.array(*map(F.lit, LIMIT_WORDS)))
    phrases = F.lit(False)
    for p in LIMIT_PHRASES:
        phrases = phrases | F.contains(lower, F.lit(p))
    return words | phrases


def dispute(prompt: Column) -> Column:
    """The label of what a message disputes, null if nothing."""
    lower = F.lower(prompt)
    claim = _first(lower, CUES)
    return F.coalesce(_first(prompt, EMPHASIS), _first(lower, LIMIT_CUES), F.when(claim.isNotNull() & about_limits(lower), LIMIT_LABEL).otherwise(claim))
