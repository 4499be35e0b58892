"""Names and lists that results depend on."""

# Fixed values.
THEMES = ("POWER", "WEALTH", "KINSHIP", "JUSTICE", "KNOWLEDGE")
ROLES = ("initiating", "enabling", "constraining", "mediating", "escalating", "resolving", "revealing")
INVOLVEMENTS = ("direct", "indirect", "latent", "none")
THEORIES = ("@McKee", "@Truby")

# Each broad type of a causal relation, and the fine types under it.
SUPERTYPES = {
    "CAUSAL_PRODUCTION": (
        "CAUSES", "DIRECT_CAUSE", "ENABLES", "FACILITATES", "TRIGGERS", "INCITING_CAUSE", "EVENT_ENABLES_NEXT",
        "EVENT_REINFORCEMENT", "DESIRE_ALIGNMENT", "NECESSITATES", "FULFILLS", "PRECEDES",
    ),
    "CAUSAL_CONSTRAINT": (
        "PREVENTS", "BLOCKS", "INHIBITS", "COMPLICATES", "OPPOSES", "DESIRE_OBSTRUCTION", "DESIRE_COMPETITION",
        "PHYSICAL_BLOCKAGE", "INTERRUPTION_OBSTACLE", "MISSION_FAILURE", "MISSION_ABANDONMENT",
    ),
    "EMOTIONAL_DRIVE": (
        "COMPASSION_TRIGGER", "EMOTIONAL_MANIPULATION", "EMOTIONAL_DEPENDENCE", "EMOTIONAL_TRIGGER",
        "EMOTIONAL_CONTAGION", "EMOTIONAL_DESPAIR", "EMOTIONAL_SUPPORT", "EMOTIONAL_APOLOGY", "EMOTIONAL_CONFESSION",
        "EMOTIONAL_ENDURANCE", "PSYCHOLOGICAL_IMPACT", "PROTECTIVE_INSTINCT", "CRUELTY_PLEASURE",
        "NOSTALGIA_INDUCEMENT", "ENRAGES",
    ),
    "SOCIAL_BOND": (
        "ALLY_DEPENDENCE", "ALLY_SUPPORT", "FAMILY_INFLUENCE", "FAMILY_BACKGROUND_REACTION", "INHERITED_OBLIGATION",
        "MENTORSHIP_SUPPORT", "MOTIVATES", "PERSUASION_ATTEMPT",
    ),
    "NARRATIVE_ESCALATION": (
        "CAUSES_REVERSAL", "ACTION_ESCALATION", "CONSCIENCE_CONFLICT", "IDENTITY_CONFLICT", "CONFLICT_OF_INTEREST",
        "PHYSICAL_CONFRONTATION", "ESCALATES", "COMPLICATES_FURTHER", "CHALLENGES", "MORAL_CHALLENGE",
        "MISSED_OPPORTUNITY", "EXPECTATION_DISAPPOINTMENT", "PERSONAL_TRANSFORMATION", "PERCEPTION_SHIFT",
    ),
    "NARRATIVE_RESOLUTION": ("RESOLVES", "CONCLUDES", "REDEEMS", "PERSONAL_JOURNEY", "MENTAL_RELIEF"),
    "REVELATION_EPISTEMIC": (
        "REVEALS", "EXPOSES", "CONCEALS", "FORESHADOWS", "PAST_CONNECTION", "LOVE_INSIGHT", "HISTORICAL_COMPARISON",
    ),
    "MEDIATION_TRANSFER": (
        "INFORMS", "MEDIATES", "TRANSFERS", "DELEGATES", "FINANCIAL_NEED", "CULTURAL_EDUCATION", "DECISION_MAKING",
    ),
    "THEMATIC_CONTRAST": ("CONTRASTS", "MIRRORS"),
    "THEMATIC_EXPLANATION": ("EXPLAINS", "SUPPORTS", "NARRATIVE_COMPOSITE"),
}

# The ontology that holds where no schema file is given.
EVENT_TYPES = (
    "PHYSICAL_MOVEMENT", "COMMUNICATION_VERBAL", "INTERNAL_THOUGHT", "EMOTIONAL_REACTION", "OBSERVATION",
    "CONFLICT_PHYSICAL", "SOCIAL_INTERACTION", "STATE_CHANGE", "ACQUISITION", "TRAVEL", "PHYSICAL_ACTION", "OTHER",
)
RELATION_TYPES = {
    "@McKee": ("DIRECT_CAUSE", "ENABLES", "PREVENTS", "TRIGGERS", "MOTIVATES", "INTERRUPTS", "INHIBITS", "PRECEDES"),
    "@Truby": ("MORAL_CHALLENGE", "WEAKNESS_EXPLOITATION", "DESIRE_FULFILLMENT", "REVELATION", "TRANSFORMATION"),
}
AGENT_TYPES = ("PROTAGONIST_HERO", "MORAL_ANTAGONIST", "ALLY_MENTOR", "STRUCTURAL_AGENT", "CRISIS_FORCER")
DEFAULT_EVENT_TYPE, DEFAULT_AGENT_TYPE = "PHYSICAL_ACTION", "STRUCTURAL_AGENT"

# Words that name no character.
PRONOUNS = (
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "they", "them", "their", "theirs", "themselves",
    "it", "its", "itself", "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
)
GENERIC_NAMES = (
    "narrator", "author", "speaker", "voice", "man", "woman", "boy", "girl", "child", "person", "people",
    "someone", "something", "anyone", "everyone", "nobody", "other", "another", "others", "one",
)
AGE_WORDS = ("Young", "Old", "Little", "Elder", "Older", "Younger")
TITLES = ("Mr.", "Mrs.", "Miss", "Ms.", "Dr.", "Sir", "Lady", "Lord")

# Words that Cypher reserves, and characters that an unquoted name can't hold.
CYPHER_RESERVED = (
    "all", "and", "as", "asc", "by", "case", "create", "delete", "desc", "distinct", "end", "else", "false", "in",
    "is", "match", "merge", "not", "null", "or", "order", "remove", "return", "set", "skip", "then", "true", "union",
    "unwind", "when", "where", "with",
)
CYPHER_SPECIAL = " -.:$!@#%^&*()[]{}/\\|?<>+=~`\"'"

# Verbs and the controlled action that they stand for.
VERB_ACTIONS = {
    "call": "name", "label": "name", "see": "perceive", "find": "perceive", "think": "imagine", "fancy": "imagine",
    "say": "say", "tell": "say", "announce": "say", "ask": "demand", "inquire": "demand", "warn": "threaten",
    "intimidate": "threaten", "bring": "give", "offer": "give", "go": "move", "leave": "move", "eat": "eat",
    "devour": "eat", "vow": "promise", "swear": "promise", "strike": "attack", "harm": "attack", "tremble": "fear",
    "cry": "fear", "look": "watch", "gaze": "watch", "symbolize": "represent", "signify": "represent",
}

# Words that hint at a reason, by category, with each category's weight alone, and its range.
WHY_LEXICON = {
    "Immediate Motivation": ("fear", "hunger", "thirst", "panic", "fright", "terror"),
    "Instrumental Cause": ("to", "in order to", "so that", "so as to", "attempt", "seek", "try", "escape", "achieve", "obtain"),
    "Contextual Cause": ("because", "since", "while", "during", "in", "at", "on", "amid"),
    "Symbolic/Emotional Cause": ("love", "guilt", "shame", "pride", "honour", "pity", "envy"),
}
WHY_BASE = {"Immediate Motivation": 0.45, "Instrumental Cause": 0.35, "Contextual Cause": 0.25, "Symbolic/Emotional Cause": 0.15}
WHY_RANGES = {"Immediate Motivation": (0.4, 0.5), "Instrumental Cause": (0.3, 0.4), "Contextual Cause": (0.2, 0.3), "Symbolic/Emotional Cause": (0.1, 0.2)}

# Heading patterns of chapters, the first that matches wins.
CHAPTER_PATTERNS = (
    r"(?md)^Chapter\s+[IVXLCDM]+\.\s*$",
    r"(?md)^CHAPTER\s+[IVXLCDM]+\.?\s*$",
    r"(?md)^Chapter\s+\d+\.?\s*$",
    r"(?md)^CHAPTER\s+\d+\.?\s*$",
    r"(?imd)^chapter\s+[IVXLCDM\d]+\.?\s*$",
)

# Edge types of productions.
EDGE_OF = {"actor": "ACTS_IN", "patient": "AFFECTED_IN", "whyfactor": "MOTIVATES", "place": "HOSTS"}
