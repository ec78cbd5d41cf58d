"""Word lists and patterns that results depend on. Sets are sorted; lists whose order decides keep it."""

# Fixed values.
KEYWORD_STOP = "a an are did do does for how i in is it my of on our project that the this to use was we were what when where which who with".split()

# Fixed values.
EMBED_STOP = (
    "a about an and are as at be been being between but by can could did do does for from had has have he her him his how if in into is it its may me might "
    "my no not of on or our shall she should so that the their then these they this those through to us was we were what when where which who why will with would you your"
).split()

# Fixed values.
SIGNIFICANT_STOP = "a an and are as at be been but by for from i in is it its my of on or our that the they this to was we were with you your".split()

# Fixed values.
SUBJECT_STOP = "a an i my our the this we".split()

# Fixed values.
NEGATION_WORDS = "aren't can't cannot did didn't do does doesn't don't isn't longer never no not wasn't weren't won't".split()
NEGATION_MARKS = ["aren't ", "doesn't ", "don't ", "isn't ", "never ", "no longer ", "not ", "wasn't "]

# Fixed values.
REPLACEMENT_MARKS = [
    "switched to", "migrated to", "changed to", "moved to", "replaced", "no longer", "instead of", "not anymore", "updated to", "upgraded to", "downgraded to",
]

# Fixed values.
VERBS = [
    "uses", "is", "runs", "has", "prefers", "requires", "supports", "includes", "contains", "speaks", "lives in", "works at", "works for", "costs", "weighs", "measures", "takes",
]

# Fixed values.
POLARITY = (
    "allegedly aren't can't cannot considering could couldn't denied denies deny denying didn't dispute disputed disputes doesn't don't doubt doubted doubts ex former formerly "
    "hadn't hasn't haven't hoped hopes if isn't maybe might neither never no no-longer nobody none nor not nothing perhaps planned plans possibly probably quit refuse refused refuses "
    "reject rejected rejects shouldn't stopped supposedly unless unlikely wanted wants wasn't weren't whether without won't would wouldn't"
).split()

# Fixed values.
TEMPORAL = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec "
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun spring summer autumn fall winter "
    "today tomorrow yesterday morning afternoon evening night day week month year am pm christmas easter"
).split()

# Fixed values.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve hundred thousand million billion first second third fourth fifth sixth seventh eighth ninth tenth"
).split()

# Fixed values.
SENTENCE_OPENERS = (
    "a about actually after all also although an and any are as at be because before both but by can could did do does every for from had has have he hello her here hey hi his how "
    "i if in is it its just later let let's may might must my no not now of ok okay on one or our out please right she should since so some still sure thanks that the their then there "
    "these they this those though to two unless up very was we well were what when where which while who whose why will with would yes you your"
).split()

# Fixed values.
TOPICS = (
    "angular api auth authentication aws azure cache cd ci cicd database deployment docker gcp git github gitlab go golang graphql grpc helm java jwt k8s kubernetes mysql nextjs oauth "
    "postgres postgresql python queue react redis rest rust testing typescript vue"
).split()

# Fixed values.
NOISE = [
    "got it", "hello", "hey", "hi there", "hmm", "i see", "let me", "no", "ok", "okay", "right", "sounds good", "sure", "thank you", "thanks", "understood", "yes",
]

# Rule patterns by priority; (memory type, extra tag, marks).
RULES = [
    ("semantic", "preference", ["prefer", "like to", "always use", "rather", "favorite", "usually"]),
    ("procedural", "workflow", ["always run", "make sure to", "before deploying", "workflow", "step 1", "first,", "process for"]),
    ("episodic", "event", ["decided to", "switched to", "migrated", "deployed", "fixed", "changed", "meeting about", "discussed"]),
    ("semantic", None, [" is ", " uses ", " has ", " runs on ", " built with ", " written in ", " deployed on ", " stored in "]),
]

# Fixed values.
RELATIONSHIPS = ["belongs_to", "contains", "relates_to", "supersedes", "caused_by", "mentions"]
MEMORY_TYPES = ["episodic", "semantic", "procedural"]
QUESTION_CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}

# Characters trimmed from the ends of a word, by purpose.
TRIM_TOKEN = ".,;:!?\"'()[]{}<>"
TRIM_KEYWORD = ".,;:!?\"'()[]{}<>-"
TRIM_EMBED = ".,;:!?\"'()[]{}/-"
TRIM_TOPIC = ".,;:!?\"'()[]{}/-"
TRIM_SIGNIFICANT = ".,;:!?\"'()-"
TRIM_ENTITY = ".,;:!?\"'“”()[]{}"
