r"""Pattern lists, labels and texts of the policy passes.

Order matters in every list. \b, \s, \d and \w carry their Unicode meaning; see
functions.regex. English patterns ignore case.
"""

# Intent -> (English, Bengali), first match wins; no match is legal_qa.
INTENTS = [
    ("section_list",
     r"\b(?:list|show|give me|what are the|enumerate)\b.{0,30}"
     r"(?:sections?|chapters?|parts?|provisions?|clauses?)\b",
     r"(?:ধারাগুলো|ধারাসমূহ|অধ্যায়গুলো|তালিকা|তালিকাভুক্ত|কোন কোন ধারা|কতটি ধারা)"),
    ("act_summary",
     r"\b(?:summarize?|summarise?|summary|overview|brief(?:ly)?|outline|"
     r"in\s+brief|give\s+me\s+(?:a\s+)?(?:brief|short|quick|overview))\b",
     r"(?:সারসংক্ষেপ|সংক্ষেপ|সংক্ষিপ্ত|সংক্ষিপ্তসার|সামারি|ওভারভিউ)"),
    ("act_explain",
     r"\b(?:explain|tell me about|what (?:is|does|covers?|contains?|includes?|are)"
     r"(?:\s+the)?|about the|describe|introduction to|purpose of|scope of)\b",
     r"(?:ব্যাখ্যা|বর্ণনা|সম্পর্কে বলুন|কী বিষয়ে|কিসের|উদ্দেশ্য|পরিচিতি|বিস্তারিত বলুন)"),
    ("legal_advice",
     r"\b(?:should\s+i|can\s+i|am\s+i\s+(?:allowed|entitled|liable|required)|"
     r"what\s+(?:should|can|must|do)\s+i|how\s+(?:do|can|should)\s+i|"
     r"is\s+it\s+legal\s+for\s+(?:me|us)|advise\s+me|my\s+rights|"
     r"what\s+are\s+my|do\s+i\s+have\s+to|can\s+(?:they|he|she|my\s+employer))\b",
     r"(?:আমার\s+কি|আমি\s+কি\s+(?:করব|পারি|পারব)|কী\s+করা\s+উচিত|"
     r"আমাকে\s+কি\s+করতে\s+হবে|আমার\s+অধিকার|পরামর্শ\s+দিন|আমার\s+ক্ষেত্রে)"),
]
DEFAULT_INTENT = "legal_qa"

# Intents that skip the decline gate.
UNGATED_INTENTS = ["act_summary", "act_explain", "legal_advice", "section_list"]

# Intent -> (prompt family, version); a null version means the active one.
PROMPT_FAMILIES = [
    ("act_summary", "act_summary", "v1"),
    ("act_explain", "act_summary", "v1"),
    ("legal_advice", "legal_advice", "v1"),
]
DEFAULT_PROMPT_FAMILY = "legal_answer"

# Questions that ask for advice.
ADVICE_EN = [
    r"\bshould\s+i\b",
    r"\bwhat\s+should\s+i\b",
    r"\bwhat\s+should\s+(?:we|my|our)\b",
    r"\bis\s+it\s+legal\s+for\s+(?:me|us|him|her|them)\b",
    r"\bcan\s+i\s+(?:sue|file|claim|take)\b",
    r"\bam\s+i\s+(?:allowed|permitted|entitled|liable|required)\b",
    r"\bdo\s+i\s+have\s+(?:to|the right)\b",
    r"\bwhat\s+(?:are|is)\s+my\s+(?:rights|options|obligations)\b",
    r"\bhow\s+(?:do|can|should)\s+i\b",
    r"\badvise\s+me\b",
    r"\btell\s+me\s+what\s+to\s+do\b",
]
ADVICE_BN = [
    r"আমার\s+কি\s+করা\s+উচিত",
    r"আমি\s+কি\s+করব",
    r"আমাকে\s+কি\s+করতে\s+হবে",
    r"আমি\s+কি\s+(?:মামলা|অভিযোগ)\s+করতে\s+পারি",
    r"আমার\s+কি\s+(?:অধিকার|করণীয়)",
    r"আমি\s+কি\s+(?:পারব|পারি)\b",
    r"কী\s+করা\s+উচিত",
    r"কী\s+করব",
    r"পরামর্শ\s+দিন",
    r"আমার\s+ক্ষেত্রে\s+(?:কী|কি)\s+প্রযোজ্য",
]

# Normative phrases: (label, pattern).
NORMATIVE_EN = [
    ("you must", r"\byou\s+must\b"),
    ("you cannot", r"\byou\s+can(?:not|'t)\b"),
    ("it is illegal", r"\bit\s+is\s+illegal\b"),
    ("you are required to", r"\byou\s+are\s+required\s+to\b"),
    ("you need to", r"\byou\s+need\s+to\b"),
    ("you must not", r"\byou\s+must\s+not\b"),
]
NORMATIVE_BN = [
    ("আপনাকে অবশ্যই", r"আপনাকে\s+অবশ্যই"),
    ("আপনি পারবেন না", r"আপনি\s+পারবেন\s+না"),
    ("এটি অবৈধ", r"এটি\s+অবৈধ"),
    ("আপনাকে করতে হবে", r"আপনাকে\s+করতে\s+হবে"),
    ("আপনি পারেন না", r"আপনি\s+পারেন\s+না"),
]

# Openers that say nothing.
FILLER_EN = [
    r"\*\*answer:\*\*\s*",
    r"answer:\s*",
    r"certainly[!,.]?\s*",
    r"sure[!,.]?\s*",
    r"of\s+course[!,.]?\s*",
    r"great\s+question[!,.]?\s*",
    r"good\s+question[!,.]?\s*",
    r"absolutely[!,.]?\s*",
    r"thank\s+you\s+for\s+(?:your\s+)?question[!,.]?\s*",
    r"based\s+on\s+the\s+(?:provided|retrieved)\s+provisions?,?\s*",
    r"according\s+to\s+the\s+(?:provided|retrieved)\s+provisions?,?\s*",
    r"as\s+per\s+the\s+(?:provided|retrieved|above)?\s*(?:law|provisions?|act)?,?\s*",
    r"the\s+retrieved\s+provisions?\s+(?:state|indicate|show|suggest)s?\s+that\s*",
    r"based\s+on\s+(?:my\s+)?(?:analysis\s+of\s+)?the\s+(?:above|provided|given)\s*[^,\n]*,?\s*",
]
FILLER_BN = [
    r"\*\*উত্তর:\*\*\s*",
    r"উত্তর:\s*",
    r"অবশ্যই[!,।]?\s*",
    r"নিশ্চয়ই[!,।]?\s*",
    r"প্রদত্ত বিধান অনুযায়ী,?\s*",
    r"উপরোক্ত বিধান অনুযায়ী,?\s*",
    r"পুনরুদ্ধার করা বিধান অনুযায়ী,?\s*",
    r"প্রদত্ত তথ্য অনুযায়ী,?\s*",
    r"আপনার প্রশ্নের উত্তরে,?\s*",
]

# Citations.
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
REFERENCE_PREFIX = r"^(?:section|part|chapter|sub-section|clause)\s+"
PLACEHOLDER = r"\{\{cite:([^}]+)\}\}|\{cite:([^}]+)\}"
FAIL_OPEN_HEADER = "Relevant provisions (no summary available):"
DISCLAIMER_MARKER = r"\*\*(?:Disclaimer|দায়মুক্তি):"

# Section numbers in a hierarchy path: scoring reads digits, sampling reads a word.
SECTION_DIGITS = r"\bSection\s+(\d+)"
SECTION_WORD = r"\bSection\s+(\w+)"

# Amendment notes: markers in a class attribute, verbs, references, years.
AMENDMENT_CLASSES = ["amend", "insert", "substitut", "footnote", "endnote"]
AMENDMENT_VERBS = ["substituted", "inserted", "added", "omitted", "replaced", "amended", "deleted"]
ACT_REFERENCE = r"Act(?:\s+No\.?)?\s+([A-Z0-9]+)\s+of\s+(\d{4})"
YEAR = r"\b(19\d{2}|20\d{2})\b"
ANNOTATION_CHARS = 500

# Words of a question that may match a hierarchy path: stripped of these, longer than this.
PATH_WORD_STRIP = "?.,;:'\"!()"
PATH_WORD_MIN_CHARS = 3

# Marks of rendered context and section lists.
PROVISION_BLOCK = ('<provision chunk_id="', '" path="', '">\n', "\n</provision>\nTo cite this provision use: {cite:", "}")
QUESTION_BLOCK = ("<question>\n", "\n</question>")
PART_LINE, CHAPTER_LINE, TITLE_MARK = "\n### Part ", "\n#### Chapter ", ": "
SECTION_IN_CHAPTER, SECTION_ALONE, SECTION_SIGN, SECTION_TITLE_MARK = "  - ", "- ", "§", " — "
OTHER_LINE = ("    - (", ")")
ACT_HEAD, ACT_NUMBER, ACT_OF, ACT_END = "## ", "*Act ", " of ", "*"
NOT_INDEXED = "\n*Section data not yet indexed. Trigger ingestion to populate.*"
