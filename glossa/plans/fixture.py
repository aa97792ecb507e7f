"""Short written texts that reach every finding rule, and by hand what each must give."""

from __future__ import annotations

TEXTS = {
    1: "The decision must be approved.",
    2: "It is recommended that the team carries out the migration.",
    3: "There is a need for closure evidence.",
    4: "The team must fix the outage cause. The team should resolve that outage cause.",
    5: "The platform service account access policy applies.",
    6: "The region-aware plans and risk-driven plans follow an end-to-end-by-design plan.",
    7: "The XYZ and ABC and QRS systems know the JSON and (DEF) forms of DEF.",
    8: "The team builds very clearly.",
    9: "We test one, two, three, four, five and six.",
    10: "The team must confirm the decision before they fix it.",
    11: "In order to pass, the team reads the blast radius.",
    12: "We (the team) plan; they [all] build; you wait, and we go, and they go, and you go.",
    13: "Mitigation, validation and verification follow.",
    14: "The framework helps us. A framework is here, and the framework is there.",
    15: "Make a decision. The plan holds.",
    16: "Our guide shows local owners roof repair prices.\n\n- one\n\nThis guide shows local owners roof repair costs.",
    17: "Use the name `must be approved` here.",
    18: "The team said that they build because they plan when they ship if they can meet us.",
    19: " ".join(["The team will wait and see what the day may bring to us all."] * 8),
    20: "The team and the group of the owners and of the sponsors wait and see what the day may bring to us all in the end of it.",
}
EXPECTED = [
    (1, "AGENCY", "must be approved"), (1, "PASSIVE", "must be approved"),
    (2, "AGENCY", "It is recommended that"), (2, "AGENCY", "is recommended"), (2, "BUREAUCRACY", "It is recommended that"), (2, "PASSIVE", "is recommended"), (2, "WEAK-VERB", "carries out"),
    (3, "INDIRECT-PREDICATE", "There is a need for closure evidence."), (3, "JARGON", "closure evidence"),
    (4, "DUPLICATED-RECOMMENDATION", "The team should resolve that outage cause."),
    (5, "NOUN-STACK", "platform service account access policy"),
    (6, "COMPOUND", "risk-driven"), (6, "COMPOUND-DEPTH", "end-to-end-by-design"),
    (7, "ABBREVIATION", "XYZ and ABC and QRS"),
    (8, "QUALIFIER", "very clearly"),
    (9, "LIST", "We test one, two, three, four, five and six."),
    (10, "MIXED-PURPOSE", "The team must confirm the decision before they fix it."),
    (11, "BUREAUCRACY", "In order to"), (11, "FILLER", "In order to"), (11, "JARGON", "blast radius"),
    (12, "ACTION", "We (the team) plan; they [all] build; you wait, and we go, and they go, and you go."), (12, "CLAUSE", "We (the team) plan; they [all] build; you wait, and we go, and they go, and you go."),
    (12, "PUNCTUATION", "We (the team) plan; they [all] build; you wait, and we go, and they go, and you go."),
    (13, "NOMINALIZATION", "Mitigation, validation and verification follow."),
    (14, "REDUNDANCY", "framework"),
    (15, "ACTOR", "Make a decision."), (15, "WEAK-VERB", "Make a decision"),
    (16, "NOUN-STACK", "owners roof repair prices"), (16, "NOUN-STACK", "owners roof repair costs"), (16, "DUPLICATED-FRAMING", "This guide shows local owners roof repair costs."),
    (18, "ACTION", "The team said that they build because they plan when they ship if they can meet us."), (18, "CLAUSE", "The team said that they build because they plan when they ship if they can meet us."),
    (19, "STRUCTURE", TEXTS[19]),
    (20, "SENTENCE", TEXTS[20]),
]
