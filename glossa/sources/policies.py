"""The shipped policies: one mapping each, by name. Everything here is data."""

from __future__ import annotations

# Fixed values of the shipped policies, in natural order.
ARCHITECTURE_REVIEW = {
    "version": "1.4.0",
    "language": "en",
    "rewrite_policy": {
        "max_readable_word_growth_percent": 10,
        "max_readable_word_growth_absolute": 12,
        "prefer_shorter_candidate": True,
    },
    "weights": {
        "sentence_load": 25,
        "morphology": 20,
        "agency": 20,
        "lexical_clarity": 15,
        "structure": 10,
        "redundancy": 10,
    },
    "bands": [("revision_required", 0, 69.99), ("usable_but_improvable", 70, 84.99), ("clear", 85, 100)],
    "thresholds": {
        "max_sentence_words": 25,
        "max_actions_per_sentence": 3,
        "max_clauses_per_sentence": 3,
        "max_nominalizations_per_sentence": 2,
        "noun_stack_words": 3,
        "max_paragraph_words": 90,
        "max_repeated_content_word": 2,
        "max_punctuation_depth": 4,
        "max_undefined_acronyms_per_sentence": 2,
        "max_undefined_acronyms_per_paragraph": 4,
        "max_inline_list_items": 4,
        "max_sentence_purposes": 2,
        "max_qualifiers_per_sentence": 2,
        "max_compound_parts": 3,
        "max_duplicate_framing_block_distance": 16,
        "max_duplicate_framing_words": 30,
        "min_duplicate_framing_shared_terms": 4,
        "min_duplicate_framing_similarity": 0.5,
    },
    "rules": {
        "abstract_evidence_heads": ["evidence", "attestation", "assurance", "artifact", "artefact"],
        "nominalization_suffixes": ["tion", "sion", "ment", "ance", "ence", "ency", "ship", "ure", "age"],
        "nominalization_exclusions": [
            "agreement", "architecture", "argument", "critical", "document", "element", "evidence", "final", "implement", "instrument", "management", "operational",
            "quality", "requirement", "several", "statement", "system",
        ],
        "nominalizations": [
            "approval", "assessment", "authorization", "classification", "closure", "configuration", "decision", "deployment", "documentation", "governance",
            "implementation", "migration", "mitigation", "observation", "operation", "ratification", "recommendation", "remediation", "resilience", "resolution",
            "testing", "validation", "verification",
        ],
        "hidden_agency": {
            "agentless decision": [
                "decision should be make", "decision should be take", "decision should be finalize", "decision should be approve", "approval should be complete",
                "ratification should be complete", "validation should be confirm", "verification should be confirm",
            ],
            "impersonal recommendation": ["it be recommend that", "it be require that", "it be expect that", "it be request that"],
            "agentless requirement": [
                "must be approve", "should be approve", "need to be approve", "must be build", "should be build", "must be complete", "should be complete",
                "must be document", "should be document", "must be implement", "should be implement", "must be provide", "should be provide", "must be resolve",
                "should be resolve", "must be review", "should be review", "must be validate", "should be validate", "must be verify", "should be verify",
                "require closure evidence",
            ],
            "indirect recommendation": ["propose defer", "recommend defer"],
            "indirect decision": ["return for human decision", "returns for human decision"],
        },
        "weak_verbs": {
            "light verb carry out": ["carry out"],
            "light verb make decision": ["make decision"],
            "light verb perform conduct": [
                "perform assessment", "perform analysis", "perform evaluation", "perform investigation", "perform review", "perform test", "perform testing",
                "conduct assessment", "conduct analysis", "conduct evaluation", "conduct investigation", "conduct review", "conduct test", "conduct testing",
            ],
            "proposal chain": ["propose defer", "recommend defer"],
        },
        "jargon": {
            "architecture jargon": ["eventual consistency", "blast radius", "single pane of glass", "north star architecture", "north star design", "north star state"],
            "machine-made compound": [
                "current state baseline", "current state architecture", "current state topology", "future state baseline", "future state architecture",
                "future state topology",
            ],
        },
        "bureaucratic_phrases": {
            "impersonal recommendation": ["it be recommend that", "it should be note that"],
            "temporal filler": ["go forward", "at this time"],
            "wordy connector": ["in order to", "as appropriate"],
            "recommend recommending": ["recommend decision propose"],
            "artificial return phrase": ["return for human decision", "returns for human decision"],
            "provisional baseline phrase": ["provisional current state baseline"],
        },
        "protected_concepts": [],
        "actor_terms": [
            "architect", "architects", "component", "components", "gateway", "group", "operator", "operators", "owner", "owners", "platform", "reviewer", "reviewers",
            "service", "services", "sponsor", "sponsors", "system", "systems", "team", "teams",
        ],
        "indirect_predicates": {
            "expletive there": ["there be need", "there be requirement", "there be risk", "there be gap", "there be issue", "there be concern"],
            "expletive it": [
                "it be important that", "it be necessary that", "it be critical that", "it be clear that", "it be unclear that", "it be possible that",
                "it be expect that",
            ],
            "purpose wrapper": ["purpose of", "goal of", "objective of", "intent of"],
        },
        "allowed_compounds": [
            "cost-effective", "evidence-based", "long-term", "near-term", "owner-approved", "read-only", "region-aware", "risk-based", "short-term", "well-known",
        ],
        "compound_modifier_suffixes": ["adjusted", "aligned", "derived", "driven", "enabled", "evidenced", "oriented", "sourced"],
        "known_acronyms": [
            "ADR", "AI", "API", "CPU", "DNS", "GB", "GPU", "HTTP", "HTTPS", "ID", "IP", "JSON", "MB", "RAM", "SDK", "SQL", "TCP", "TLS", "UI", "URL", "UTC", "UX", "VM",
            "XML", "YAML",
        ],
        "purpose_markers": {
            "decision": [
                "accept", "approval", "approve", "decide", "decision", "defer", "deferral", "reject", "rejection", "recommend", "recommendation", "ratification",
                "ratify",
            ],
            "remediation": [
                "address", "correct", "fix", "harden", "implement", "implementation", "mitigate", "mitigation", "patch", "remediate", "remediation", "repair", "remove",
                "removal", "replace", "resolve", "update",
            ],
            "evidence": ["confirm", "demonstrate", "demonstration", "evidence", "prove", "publish", "validate", "validation", "verify", "verification"],
            "exit criteria": ["after", "before", "exit criteria", "gate", "sign off", "until", "when"],
        },
        "filler_phrases": {
            "purpose filler": ["in order to", "for purpose of", "for the purpose of"],
            "temporal filler": ["at this point in time", "at this time"],
            "noting filler": ["it should be note that"],
        },
        "recommendation_action_groups": {
            "approve": ["approve", "ratify"],
            "evidence": ["document", "publish", "provide"],
            "fix": ["address", "fix", "mitigate", "remediate", "resolve"],
            "validate": ["check", "confirm", "test", "validate", "verify"],
        },
        "qualifiers": [
            "appropriately", "basically", "clearly", "fairly", "generally", "materially", "quite", "really", "relatively", "significantly", "somewhat", "substantially",
            "very",
        ],
    },
}
PRODUCT_STRATEGY = {
    "version": "1.1.0",
    "language": "en",
    "rewrite_policy": {
        "max_readable_word_growth_percent": 10,
        "max_readable_word_growth_absolute": 12,
        "prefer_shorter_candidate": True,
    },
    "weights": {
        "sentence_load": 15,
        "morphology": 15,
        "agency": 25,
        "lexical_clarity": 25,
        "structure": 8,
        "redundancy": 12,
    },
    "bands": [("revision_required", 0, 69.99), ("usable_but_improvable", 70, 84.99), ("clear", 85, 100)],
    "thresholds": {
        "max_sentence_words": 22,
        "max_actions_per_sentence": 3,
        "max_clauses_per_sentence": 3,
        "max_nominalizations_per_sentence": 2,
        "noun_stack_words": 3,
        "max_paragraph_words": 80,
        "max_repeated_content_word": 3,
        "max_punctuation_depth": 4,
        "max_undefined_acronyms_per_sentence": 1,
        "max_undefined_acronyms_per_paragraph": 3,
        "max_inline_list_items": 3,
        "max_sentence_purposes": 2,
        "max_qualifiers_per_sentence": 1,
        "max_compound_parts": 3,
        "max_duplicate_framing_block_distance": 16,
        "max_duplicate_framing_words": 30,
        "min_duplicate_framing_shared_terms": 4,
        "min_duplicate_framing_similarity": 0.5,
        "require_responsible_actor": 1,
    },
    "rules": {
        "nominalization_suffixes": ARCHITECTURE_REVIEW["rules"]["nominalization_suffixes"],
        "nominalization_exclusions": [
            "agreement", "architecture", "argument", "audience", "compliance", "coverage", "document", "element", "evidence", "experience", "governance", "instrument",
            "insurance", "management", "package", "percentage", "performance", "requirement", "segment", "statement", "usage",
        ],
        "nominalizations": [
            "alignment", "assessment", "assumption", "collaboration", "communication", "consideration", "determination", "differentiation", "enablement", "execution",
            "expectation", "exploration", "identification", "implementation", "integration", "iteration", "measurement", "optimization", "prioritization", "realization",
            "utilization", "validation", "verification",
        ],
        "hidden_agency": {
            "agentless decision": [
                "bet be place", "choice be make", "decision be make", "decision should be make", "priority be set", "roadmap be define", "scope be define",
                "trade off be make",
            ],
            "impersonal claim": ["it be assume that", "it be believe that", "it be estimate that", "it be expect that", "it be project that", "it be understand that"],
            "agentless commitment": [
                "must be build", "must be deliver", "must be launch", "must be measure", "must be prioritize", "must be ship", "must be validate", "should be build",
                "should be deliver", "should be launch", "should be measure", "should be prioritize", "should be ship", "should be validate", "will be deliver",
            ],
            "agentless market claim": [
                "adoption be drive", "cost be reduce", "demand be drive", "growth be drive", "need be address", "pain be feel", "problem be solve",
                "revenue be generate", "value be create", "value be deliver", "value be unlock",
            ],
        },
        "weak_verbs": {
            "light verb make": ["make assumption", "make commitment", "make decision", "make improvement", "make investment", "make progress"],
            "light verb provide": ["provide benefit", "provide capability", "provide insight", "provide support", "provide value", "provide visibility"],
            "light verb drive": ["drive adoption", "drive engagement", "drive growth", "drive impact", "drive outcome", "drive value"],
            "light verb deliver": ["deliver benefit", "deliver impact", "deliver outcome", "deliver value"],
            "light verb enable": ["enable growth", "enable outcome", "enable value"],
            "light verb perform conduct": ["conduct analysis", "conduct interview", "conduct research", "conduct study", "perform analysis", "perform evaluation"],
        },
        "jargon": {
            "consultant abstraction": [
                "boil the ocean", "core competency", "holistic solution", "low hang fruit", "move the needle", "operationalize", "paradigm shift",
                "strategic initiative", "synergy", "think leadership", "thought leadership", "value add",
            ],
            "growth cliche": ["growth hack", "hockey stick", "land and expand", "rocket ship", "supercharge", "turbocharge", "unlock value", "viral loop"],
            "unfalsifiable superlative": [
                "best in class", "bulletproof", "cut edge", "frictionless", "game change", "game changer", "good in class", "good of breed", "industry lead",
                "next generation", "seamless", "second to none", "state of the art", "turnkey", "unmatched", "unparalleled", "well in class", "well of breed",
                "world class",
            ],
            "vague differentiator": ["differentiate offer", "differentiate offering", "secret sauce", "special sauce", "sticky product", "unfair advantage", "unique value proposition"],
        },
        "bureaucratic_phrases": {
            "impersonal claim": ["it be believe that", "it be well know that", "it be widely accept that", "it should be note that"],
            "wordy connector": ["as appropriate", "as it relate to", "in order to", "in term of", "on a go forward basis", "with respect to"],
            "throat clearing": ["at the end of the day", "it be important to note that", "needless to say", "when all be say and do"],
            "market hand wave": ["the industry be move", "the market be demand", "the market want", "the space be crowd"],
        },
        "filler_phrases": {
            "purpose filler": ["for purpose of", "for the purpose of", "in order to"],
            "temporal filler": ["at this point in time", "at this time", "go forward"],
            "closing filler": ["at the end of the day", "needless to say"],
        },
        "qualifiers": [
            "arguably", "basically", "clearly", "dramatically", "essentially", "fundamentally", "generally", "incredibly", "largely", "massively", "obviously",
            "potentially", "presumably", "quite", "really", "relatively", "roughly", "significantly", "somewhat", "substantially", "truly", "very", "virtually",
        ],
        "indirect_predicates": {
            "expletive there": ["there be appetite", "there be demand", "there be gap", "there be market", "there be need", "there be opportunity", "there be risk"],
            "expletive it": ["it be clear that", "it be critical that", "it be essential that", "it be important that", "it be obvious that", "it be worth note that"],
            "purpose wrapper": ["aim of", "goal of", "mission of", "objective of", "purpose of", "vision of"],
        },
        "purpose_markers": {
            "claim": ["assert", "believe", "claim", "differentiate", "position", "promise", "propose"],
            "evidence": ["benchmark", "cite", "data", "demonstrate", "evidence", "measure", "prove", "show", "validate", "verify"],
            "mechanism": ["automate", "build", "collect", "deliver", "detect", "implement", "integrate", "operate", "ship"],
            "commercial": ["bill", "charge", "cost", "margin", "monetize", "price", "revenue", "sell", "subscribe"],
            "risk": ["depend", "dependency", "expose", "exposure", "mitigate", "risk", "threat"],
        },
        "recommendation_action_groups": {
            "commit": ["commit", "guarantee", "promise"],
            "build": ["build", "deliver", "implement", "ship"],
            "measure": ["benchmark", "instrument", "measure", "track", "validate"],
            "decide": ["choose", "decide", "defer", "prioritize"],
        },
        "abstract_evidence_heads": ["evidence", "proof", "traction", "signal", "insight", "learning", "validation"],
        "actor_terms": [
            "buyer", "buyers", "company", "competitor", "competitors", "customer", "customers", "engineer", "engineers", "founder", "founders", "incumbent",
            "incumbents", "merchant", "merchants", "operator", "operators", "owner", "owners", "partner", "partners", "platform", "platforms", "provider", "providers",
            "reviewer", "reviewers", "seller", "sellers", "sponsor", "sponsors", "team", "teams", "user", "users", "vendor", "vendors",
        ],
        "allowed_compounds": [
            "best-effort", "break-even", "cost-effective", "cross-sell", "data-driven", "end-to-end", "evidence-based", "first-party", "go-to-market", "high-touch",
            "long-term", "low-touch", "near-term", "off-the-shelf", "out-of-the-box", "product-led", "sales-led", "self-serve", "short-term", "third-party",
            "well-known",
        ],
        "compound_modifier_suffixes": ["aware", "backed", "based", "driven", "facing", "focused", "funded", "led", "oriented", "ready"],
        "known_acronyms": [
            "API", "ARR", "B2B", "B2C", "CAC", "CAGR", "CRM", "CSV", "GTM", "HTTP", "HTTPS", "ICP", "ID", "JSON", "KPI", "LTV", "MRR", "MVP", "NPS", "OKR", "QA", "RFP",
            "ROI", "SDK", "SEO", "SKU", "SLA", "SMB", "SOM", "SQL", "TAM", "UI", "URL", "UX",
        ],
        "protected_concepts": [],
    },
}
WEB_COPY = {
    "version": "1.2.0",
    "language": "en",
    "rewrite_policy": {
        "max_readable_word_growth_percent": 10,
        "max_readable_word_growth_absolute": 12,
        "prefer_shorter_candidate": True,
    },
    "weights": {
        "sentence_load": 20,
        "morphology": 25,
        "agency": 12,
        "lexical_clarity": 25,
        "structure": 8,
        "redundancy": 10,
    },
    "bands": [("revision_required", 0, 69.99), ("usable_but_improvable", 70, 84.99), ("clear", 85, 100)],
    "thresholds": {
        "max_sentence_words": 20,
        "max_actions_per_sentence": 2,
        "max_clauses_per_sentence": 2,
        "max_nominalizations_per_sentence": 1,
        "noun_stack_words": 3,
        "max_paragraph_words": 70,
        "max_repeated_content_word": 3,
        "max_punctuation_depth": 3,
        "max_undefined_acronyms_per_sentence": 1,
        "max_undefined_acronyms_per_paragraph": 2,
        "max_inline_list_items": 3,
        "max_sentence_purposes": 2,
        "max_qualifiers_per_sentence": 1,
        "max_compound_parts": 2,
        "max_duplicate_framing_block_distance": 16,
        "max_duplicate_framing_words": 30,
        "min_duplicate_framing_shared_terms": 4,
        "min_duplicate_framing_similarity": 0.5,
        "allow_implied_subject": 1,
    },
    "rules": {
        "nominalization_suffixes": ARCHITECTURE_REVIEW["rules"]["nominalization_suffixes"],
        "nominalization_exclusions": [
            "age", "agreement", "architecture", "argument", "audience", "average", "compliance", "coverage", "document", "element", "evidence", "experience", "feature",
            "figure", "governance", "government", "heritage", "infrastructure", "instrument", "insurance", "intelligence", "language", "management", "measure",
            "mission", "package", "percentage", "performance", "procedure", "requirement", "segment", "signature", "statement", "structure", "usage",
        ],
        "nominalizations": PRODUCT_STRATEGY["rules"]["nominalizations"],
        "hidden_agency": PRODUCT_STRATEGY["rules"]["hidden_agency"],
        "weak_verbs": PRODUCT_STRATEGY["rules"]["weak_verbs"],
        "jargon": {
            "consultant abstraction": [
                "boil the ocean", "core competency", "low hang fruit", "move the needle", "operationalize", "strategic initiative", "synergy", "think leadership",
                "thought leadership", "value add",
            ],
            "growth cliche": ["growth hack", "hockey stick", "land and expand", "rocket ship", "supercharge", "turbocharge", "unlock value", "viral loop"],
            "unfalsifiable superlative": [
                "best in class", "bleed edge", "bulletproof", "cut edge", "frictionless", "game change", "game changer", "good in class", "good of breed",
                "industry lead", "market lead", "mission critical", "next generation", "premier", "seamless", "second to none", "state of the art", "turnkey",
                "unmatched", "unparalleled", "unrivaled", "well in class", "well of breed", "world class",
            ],
            "vague differentiator": ["differentiate offer", "differentiate offering", "secret sauce", "special sauce", "sticky product", "unfair advantage", "unique value proposition"],
            "ai cadence": [
                "delve", "ecosystem of", "elevate", "embark", "ever evolve", "foster", "harness the power", "holistic", "in today 's world", "leverage",
                "navigate the landscape", "paradigm", "rapidly evolve", "realm of", "robust", "showcase", "spearhead", "streamline", "tapestry", "testament to",
                "underscore", "unlock the power", "utilize", "vibrant",
            ],
            "recruiting cliche": [
                "competitive salary", "dynamic team", "exciting opportunity", "fast pace environment", "hit the ground run", "join our team", "like a family",
                "make an impact", "passionate about", "rock star", "self starter", "team player", "think outside the box", "wear many hat", "work hard play hard",
            ],
        },
        "bureaucratic_phrases": PRODUCT_STRATEGY["rules"]["bureaucratic_phrases"],
        "filler_phrases": PRODUCT_STRATEGY["rules"]["filler_phrases"],
        "qualifiers": [
            "arguably", "basically", "clearly", "countless", "dramatically", "essentially", "extremely", "fundamentally", "generally", "highly", "incredibly", "largely",
            "massively", "myriad", "numerous", "obviously", "plethora", "potentially", "presumably", "quite", "really", "relatively", "robustly", "roughly",
            "seamlessly", "significantly", "somewhat", "substantially", "truly", "very", "virtually",
        ],
        "indirect_predicates": PRODUCT_STRATEGY["rules"]["indirect_predicates"],
        "purpose_markers": PRODUCT_STRATEGY["rules"]["purpose_markers"],
        "recommendation_action_groups": PRODUCT_STRATEGY["rules"]["recommendation_action_groups"],
        "abstract_evidence_heads": PRODUCT_STRATEGY["rules"]["abstract_evidence_heads"],
        "actor_terms": [
            "agencies", "agency", "analyst", "analysts", "applicant", "applicants", "candidate", "candidates", "commuter", "commuters", "companies", "company",
            "contractor", "contractors", "developer", "developers", "employee", "employees", "employer", "employers", "engineer", "engineers", "manager", "managers",
            "office", "offices", "operator", "operators", "recruiter", "recruiters", "resident", "residents", "staff", "team", "teams", "worker", "workers",
        ],
        "allowed_compounds": [
            "best-effort", "break-even", "cost-effective", "cross-sell", "data-driven", "day-to-day", "end-to-end", "entry-level", "evidence-based", "first-party",
            "full-scope", "go-to-market", "hands-on", "high-touch", "long-term", "low-touch", "mid-career", "near-term", "off-the-shelf", "on-site", "out-of-the-box",
            "product-led", "public-facing", "sales-led", "self-serve", "short-term", "single-scope", "third-party", "top-secret", "well-known",
        ],
        "compound_modifier_suffixes": PRODUCT_STRATEGY["rules"]["compound_modifier_suffixes"],
        "known_acronyms": [
            "API", "ARR", "ATS", "AWS", "B2B", "B2C", "CAC", "CAGR", "CI", "CIA", "CRM", "CSV", "DIA", "DISA", "DNI", "DoD", "FBI", "GEOINT", "GTM", "HR", "HTTP",
            "HTTPS", "ICP", "ID", "IT", "JSON", "KPI", "LTV", "MD", "MRR", "MVP", "NGA", "NPS", "NSA", "OKR", "PTO", "QA", "RFP", "ROI", "SCI", "SDK", "SEO", "SIGINT",
            "SKU", "SLA", "SMB", "SOM", "SQL", "TAM", "TS", "UI", "URL", "US", "USA", "UX",
        ],
        "protected_concepts": [],
    },
}
RESUME_REVIEW = {
    "version": "1.1.0",
    "language": "en",
    "rewrite_policy": {
        "max_readable_word_growth_percent": 10,
        "max_readable_word_growth_absolute": 12,
        "prefer_shorter_candidate": True,
    },
    "weights": {
        "sentence_load": 8,
        "morphology": 25,
        "agency": 30,
        "lexical_clarity": 15,
        "structure": 2,
        "redundancy": 20,
    },
    "bands": [("revision_required", 0, 69.99), ("usable_but_improvable", 70, 84.99), ("clear", 85, 100)],
    "thresholds": {
        "max_sentence_words": 20,
        "max_actions_per_sentence": 3,
        "max_clauses_per_sentence": 3,
        "max_nominalizations_per_sentence": 1,
        "noun_stack_words": 3,
        "max_paragraph_words": 60,
        "max_repeated_content_word": 2,
        "max_punctuation_depth": 3,
        "max_undefined_acronyms_per_sentence": 2,
        "max_undefined_acronyms_per_paragraph": 4,
        "max_inline_list_items": 4,
        "max_sentence_purposes": 2,
        "max_qualifiers_per_sentence": 0,
        "max_compound_parts": 3,
        "max_duplicate_framing_block_distance": 16,
        "max_duplicate_framing_words": 30,
        "min_duplicate_framing_shared_terms": 4,
        "min_duplicate_framing_similarity": 0.5,
        "require_responsible_actor": 1,
        "allow_implied_first_person": 1,
        "count_repetition_across_blocks": 1,
    },
    "rules": {
        "abstract_evidence_heads": ["background", "expertise", "experience", "exposure", "knowledge", "responsibility", "skill"],
        "nominalization_suffixes": ARCHITECTURE_REVIEW["rules"]["nominalization_suffixes"],
        "nominalization_exclusions": [
            "agreement", "architecture", "audience", "average", "conference", "coverage", "culture", "department", "document", "element", "equipment", "evidence",
            "feature", "figure", "future", "image", "infrastructure", "instrument", "internship", "language", "literature", "measure", "membership", "message", "nature",
            "package", "page", "percentage", "picture", "reference", "requirement", "scholarship", "science", "sentence", "stage", "statement", "storage", "structure",
            "system",
        ],
        "nominalizations": ["analysis", "delivery", "growth", "handoff", "increase", "oversight", "redesign", "rollout", "upkeep"],
        "hidden_agency": {
            "agentless responsibility": ["accountable for", "in charge of", "responsible for"],
            "assigned without an agent": ["charge with", "task with"],
            "duty list": ["duty include", "responsibility include"],
        },
        "weak_verbs": {
            "unspecified support": ["assist with", "contribute to", "help to", "work on"],
            "unspecified participation": ["engage in", "involve in", "participate in", "take part in"],
            "claimed acquaintance": ["exposure to", "familiar with", "work knowledge of"],
        },
        "jargon": {
            "office idiom": ["bring to the table", "go the extra mile", "hit the ground run", "hit the ground running", "outside the box", "wear many hat"],
            "self-description cliche": [
                "detail orient", "dynamic professional", "go getter", "hard worker", "highly motivate", "highly motivated", "passionate about", "people person",
                "result drive", "results drive", "season professional", "seasoned professional", "self starter", "team player",
            ],
            "unfalsifiable credential": ["excellent communication skill", "extensive experience", "strong work ethic", "think leader", "thought leader", "track record"],
            "job title inflation": ["guru", "ninja", "rockstar", "superstar"],
        },
        "bureaucratic_phrases": {
            "unquantified quantity": ["a number of", "a variety of", "a wide range of"],
            "wordy connector": ["in a timely manner", "in order to", "on a daily basis", "on a regular basis"],
        },
        "filler_phrases": {
            "hollow intensifier": ["consistently", "effectively", "efficiently", "greatly", "proactively", "seamlessly", "significantly", "substantially", "successfully"],
            "unquantified quantity": ["numerous", "several", "various"],
        },
        "indirect_predicates": {
            "role wrapper": ["aim of", "focus of", "function of", "role of"],
            "impersonal role statement": ["it be my responsibility to", "it be possible to"],
        },
        "protected_concepts": [],
        "actor_terms": ["client", "clients", "customer", "customers", "stakeholder", "stakeholders", "team", "teams", "user", "users"],
        "allowed_compounds": ["cross-functional", "day-to-day", "end-to-end", "full-stack", "long-term", "on-call", "open-source", "peer-reviewed", "real-time", "short-term"],
        "compound_modifier_suffixes": ["aligned", "based", "centric", "driven", "enabled", "facing", "focused", "minded", "oriented", "ready"],
        "known_acronyms": [
            "AI", "API", "BS", "CD", "CI", "CPU", "CRM", "CSS", "ERP", "ETL", "GB", "GPA", "GPU", "HR", "HTML", "HTTP", "HTTPS", "ID", "IT", "JSON", "KPI", "MB", "MBA",
            "ML", "MS", "OKR", "PM", "QA", "REST", "ROI", "SDK", "SLA", "SQL", "SRE", "TCP", "TLS", "UI", "URL", "UX", "VM", "XML", "YAML",
        ],
        "purpose_markers": {
            "delivery": ["build", "create", "deliver", "deploy", "develop", "launch", "ship"],
            "leadership": ["coach", "coordinate", "direct", "lead", "manage", "mentor", "supervise"],
            "analysis": ["analyze", "assess", "evaluate", "investigate", "research"],
            "improvement": ["automate", "cut", "improve", "optimize", "reduce", "streamline"],
            "communication": ["document", "present", "publish", "report", "write"],
        },
        "recommendation_action_groups": {
            "build": ["build", "create", "develop", "implement", "launch", "ship"],
            "lead": ["direct", "lead", "manage", "mentor", "oversee", "supervise"],
            "improve": ["automate", "improve", "optimize", "reduce", "streamline"],
            "analyze": ["analyze", "assess", "evaluate", "measure", "review"],
        },
        "qualifiers": [
            "arguably", "basically", "broadly", "essentially", "extremely", "fairly", "generally", "highly", "largely", "mostly", "quite", "rather", "relatively",
            "somewhat", "strongly", "typically", "usually", "very", "virtually",
        ],
    },
}
LOCAL_SERVICE = {
    "version": "1.1.0",
    "language": "en",
    "rewrite_policy": {
        "max_readable_word_growth_percent": 10,
        "max_readable_word_growth_absolute": 12,
        "prefer_shorter_candidate": True,
    },
    "weights": {
        "lexical_clarity": 32,
        "agency": 22,
        "morphology": 18,
        "sentence_load": 16,
        "redundancy": 8,
        "structure": 4,
    },
    "bands": [("revision_required", 0, 77.99), ("usable_but_improvable", 78, 89.99), ("clear", 90, 100)],
    "thresholds": {
        "max_sentence_words": 18,
        "max_actions_per_sentence": 2,
        "max_clauses_per_sentence": 2,
        "max_nominalizations_per_sentence": 1,
        "noun_stack_words": 3,
        "max_paragraph_words": 60,
        "max_repeated_content_word": 3,
        "max_punctuation_depth": 3,
        "max_undefined_acronyms_per_sentence": 1,
        "max_undefined_acronyms_per_paragraph": 2,
        "max_inline_list_items": 3,
        "max_sentence_purposes": 2,
        "max_qualifiers_per_sentence": 1,
        "max_compound_parts": 2,
        "max_duplicate_framing_block_distance": 16,
        "max_duplicate_framing_words": 30,
        "min_duplicate_framing_shared_terms": 4,
        "min_duplicate_framing_similarity": 0.5,
    },
    "rules": {
        "nominalization_suffixes": ARCHITECTURE_REVIEW["rules"]["nominalization_suffixes"],
        "nominalization_exclusions": [
            "agreement", "architecture", "argument", "audience", "compliance", "coverage", "document", "element", "evidence", "experience", "feature", "governance",
            "government", "heritage", "infrastructure", "instrument", "insurance", "intelligence", "language", "management", "measure", "mission", "package",
            "percentage", "performance", "procedure", "requirement", "segment", "signature", "statement", "structure", "usage",
        ],
        "nominalizations": PRODUCT_STRATEGY["rules"]["nominalizations"],
        "hidden_agency": PRODUCT_STRATEGY["rules"]["hidden_agency"],
        "weak_verbs": PRODUCT_STRATEGY["rules"]["weak_verbs"],
        "jargon": {
            "consultant abstraction": [
                "boil the ocean", "core competency", "low hang fruit", "move the needle", "operationalize", "strategic initiative", "synergy", "think leadership",
                "thought leadership", "value add",
            ],
            "growth cliche": ["growth hack", "hockey stick", "land and expand", "rocket ship", "supercharge", "turbocharge", "unlock value", "viral loop"],
            "unfalsifiable superlative": [
                "best in class", "bleed edge", "bulletproof", "cut edge", "frictionless", "game change", "game changer", "good in class", "good of breed",
                "industry lead", "market lead", "mission critical", "next generation", "premier", "seamless", "second to none", "state of the art", "turnkey",
                "unmatched", "unparalleled", "unrivaled", "well in class", "well of breed", "world class",
            ],
            "vague differentiator": ["differentiate offer", "differentiate offering", "secret sauce", "special sauce", "sticky product", "unfair advantage", "unique value proposition"],
            "ai cadence": [
                "delve", "ecosystem of", "elevate", "embark", "ever evolve", "foster", "harness the power", "holistic", "in today 's world", "leverage",
                "navigate the landscape", "paradigm", "rapidly evolve", "realm of", "robust", "showcase", "spearhead", "streamline", "tapestry", "testament to",
                "underscore", "unlock the power", "utilize", "vibrant",
            ],
            "recruiting cliche": [
                "competitive salary", "dynamic team", "exciting opportunity", "fast pace environment", "hit the ground run", "join our team", "like a family",
                "make an impact", "passionate about", "rock star", "self starter", "team player", "think outside the box", "wear many hat", "work hard play hard",
            ],
            "local service cliche": [
                "100 percent satisfaction", "attention to detail", "big or small", "competitive rate", "exceptional customer service", "family own", "fast and friendly",
                "hassle free", "here for you", "honest and reliable", "local expert", "money back guarantee", "no job be too big", "no job be too small",
                "one stop shop", "peace of mind", "pride ourselves", "prompt and professional", "quality workmanship", "satisfaction be our top priority",
                "satisfaction guarantee", "top notch", "trusted name", "unbeatable price", "we be here to help", "we have you cover", "we treat your home like our own",
                "your satisfaction be our",
            ],
            "unverifiable trust claim": [
                "a plus rating", "background check technician", "bond and insure", "certify technician", "decade of experience", "factory train", "fully insure",
                "fully license", "license and insure", "serve homeowner since", "serve the area since", "thousand of satisfied customer", "trust by homeowner",
                "year of experience",
            ],
            "unsubstantiated offer": [
                "24 7 emergency service", "available 24 7", "free estimate", "free quote", "hidden fee", "no obligation quote", "same day service guarantee",
                "transparent pricing", "upfront pricing",
            ],
        },
        "bureaucratic_phrases": PRODUCT_STRATEGY["rules"]["bureaucratic_phrases"],
        "filler_phrases": PRODUCT_STRATEGY["rules"]["filler_phrases"],
        "qualifiers": WEB_COPY["rules"]["qualifiers"],
        "indirect_predicates": PRODUCT_STRATEGY["rules"]["indirect_predicates"],
        "purpose_markers": PRODUCT_STRATEGY["rules"]["purpose_markers"],
        "recommendation_action_groups": PRODUCT_STRATEGY["rules"]["recommendation_action_groups"],
        "abstract_evidence_heads": PRODUCT_STRATEGY["rules"]["abstract_evidence_heads"],
        "actor_terms": [
            "agencies", "agency", "analyst", "analysts", "applicant", "applicants", "candidate", "candidates", "commuter", "commuters", "companies", "company",
            "contractor", "contractors", "crew", "crews", "developer", "developers", "electrician", "electricians", "employee", "employees", "employer", "employers",
            "engineer", "engineers", "homeowner", "homeowners", "inspector", "inspectors", "landlord", "landlords", "manager", "managers", "neighbour", "neighbours",
            "office", "offices", "operator", "operators", "plumber", "plumbers", "recruiter", "recruiters", "resident", "residents", "staff", "team", "teams",
            "technician", "technicians", "tenant", "tenants", "worker", "workers",
        ],
        "allowed_compounds": [
            "after-hours", "best-effort", "break-even", "code-compliant", "cost-effective", "crawl-space", "cross-sell", "data-driven", "day-to-day", "drop-in",
            "end-to-end", "entry-level", "evidence-based", "first-party", "flat-rate", "full-scope", "go-to-market", "hands-on", "high-touch", "load-bearing",
            "long-term", "low-touch", "mid-career", "near-term", "off-the-shelf", "on-site", "out-of-the-box", "product-led", "public-facing", "sales-led", "same-day",
            "self-serve", "short-term", "single-scope", "single-story", "split-level", "third-party", "top-secret", "up-to-code", "well-known",
        ],
        "compound_modifier_suffixes": PRODUCT_STRATEGY["rules"]["compound_modifier_suffixes"],
        "known_acronyms": [
            "AC", "AFUE", "API", "ARR", "ATS", "AWS", "B2B", "B2C", "BTU", "CAC", "CAGR", "CFM", "CI", "CIA", "CRM", "CSV", "DIA", "DISA", "DNI", "DoD", "EPA", "FBI",
            "GEOINT", "GFCI", "GTM", "HEPA", "HR", "HTTP", "HTTPS", "HVAC", "IAQ", "ICP", "ID", "IT", "JSON", "KPI", "LTV", "MD", "MERV", "MRR", "MVP", "NATE", "NFPA",
            "NGA", "NPS", "NSA", "OKR", "OSHA", "PEX", "PSI", "PTO", "PVC", "QA", "RFP", "ROI", "SCI", "SDK", "SEER", "SEO", "SIGINT", "SKU", "SLA", "SMB", "SOM", "SQL",
            "TAM", "TPO", "TS", "UI", "URL", "US", "USA", "UV", "UX",
        ],
        "protected_concepts": [],
    },
}
# End of the fixed values.

POLICIES = {"architecture-review": ARCHITECTURE_REVIEW, "product-strategy": PRODUCT_STRATEGY, "web-copy": WEB_COPY, "resume-review": RESUME_REVIEW, "local-service": LOCAL_SERVICE}
