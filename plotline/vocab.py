"""Closed vocabularies, thresholds and word lists.

Fixed values: every entry here must equal the data contract of the tables and
the published matching rules, so they are written out plainly.
"""

UNIT_TYPES = ["scene_heading", "action", "character", "dialogue", "parenthetical",
              "transition", "shot", "note"]
PARSER_METHODS = ["fountain", "fdx", "pdf_layout", "rule", "ocr", "agent_repair",
                  "user_corrected"]
ENTITY_TYPES = ["cast", "prop", "wardrobe", "location", "set_design", "makeup",
                "transportation", "vfx", "stunt", "sound"]
PREDICATES = ["appears_in", "occurs_at", "wears", "carries", "uses", "requires",
              "travels_by", "interacts_with", "establishes"]
APPEARANCE_MANNERS = ["on_stage", "referenced", "depicted"]
NODE_KINDS = ["entity", "scene"]
PROVENANCE = ["model", "user", "accepted_change", "system"]
IMPORT_OUTCOMES = ["accepted", "accepted_with_warnings", "needs_review", "rejected"]
RUN_STATUSES = ["pending", "running", "partially_ready", "ready", "failed", "cancelled"]
SCENE_STATUSES = ["pending", "running", "completed", "failed", "cancelled"]
CHANGE_KINDS = ["edit", "multi_unit_edit", "undo", "direct_save", "omit_scene",
                "link_draft", "merge_entities"]
CHANGE_STATUSES = ["pending", "accepted", "rejected", "stale", "reverted", "failed"]
OPERATION_TYPES = ["add_assertion", "remove_assertion", "update_assertion",
                   "create_entity", "update_entity", "set_entity_attribute",
                   "remove_entity_attribute", "set_unit_text", "set_scene_omitted"]
FINDING_STATUSES = ["open", "dismissed", "resolved"]
GRAPH_STATUSES = ["not_analysed", "analysing", "partially_ready", "ready", "failed"]
SCRIPT_ORIGINS = ["bundled", "upload"]
CALL_PURPOSES = ["extract", "judge", "continuity", "synthesize", "query", "agent", "draft"]
CALL_OUTCOMES = ["ok", "cached", "provider_error", "malformed", "truncated",
                 "incomplete", "budget_refused"]

# predicate -> (subject kind, object kind, subject types, object types); None = any.
SIGNATURES = {
    "appears_in": ("entity", "scene", ["cast"], None),
    "occurs_at": ("scene", "entity", None, ["location"]),
    "wears": ("entity", "entity", ["cast"], ["wardrobe", "makeup"]),
    "carries": ("entity", "entity", ["cast"], ["prop"]),
    "uses": ("entity", "entity", ["cast"], ["prop", "set_design", "transportation", "vfx"]),
    "travels_by": ("entity", "entity", ["cast"], ["transportation"]),
    "interacts_with": ("entity", "entity", ["cast"], ["cast"]),
    "requires": ("scene", "entity", None,
                 [t for t in ENTITY_TYPES if t not in ("cast", "location")]),
    "establishes": ("scene", "entity", None, ENTITY_TYPES),
}
SYMMETRIC_PREDICATES = ["interacts_with"]
USE_PREDICATES = ["appears_in", "requires", "wears", "carries", "uses", "travels_by"]
PRESENCE_PREDICATES = ["appears_in", "occurs_at"]

# Limits and thresholds.
MAX_UPLOAD_BYTES = 8 * 1024 * 1024
MAX_SCENES = 400
MAX_UNITS_PER_SCENE = 2000
CHARS_PER_PAGE = 800
UNITS_PER_WINDOW = 120
BURST_GAP_SECONDS = 20 * 60
QUESTION_WINDOW_SECONDS = 120
MAX_EVIDENCE_ITEMS = 40
MAX_NEIGHBOURS = 20
PACKET_ASSERTION_CAP = 1000
ROSTER_NAME_CAP = 80
FINDING_EVIDENCE_CAP = 8
STRONG_MATCH = 0.65
WEAK_MATCH = 0.50
RENAME_AUTO_SHARE = 0.8
RENAME_SUGGEST_SHARE = 0.5
RENAME_MIN_POSITIONS = 3
DRAFT_KEEP_SHARE = 0.35
DISCARD_BELOW = 0.5
MINIMUM_CONFIDENCE = 0.35

TIMES_OF_DAY = ["DAY", "NIGHT", "MORNING", "AFTERNOON", "EVENING", "DAWN", "DUSK",
                "CONTINUOUS", "LATER", "MOMENTS LATER", "SAME", "SAME TIME",
                "MAGIC HOUR", "PRE-DAWN", "MIDNIGHT", "SUNSET", "SUNRISE"]

TITLE_ABBREVIATIONS = ["MR", "MRS", "MS", "DR", "ST", "PROF", "REV", "CAPT", "LT", "SGT",
                       "GEN", "COL", "MAJ", "HON", "MME", "MLLE", "SR", "JR", "FR"]

PRONOUNS = ["i", "me", "my", "mine", "we", "us", "our", "you", "your", "he", "him", "his",
            "she", "her", "hers", "it", "its", "they", "them", "their", "theirs", "who",
            "whom"]

NON_ENTITY_NAMES = [
    "he", "she", "it", "they", "him", "her", "them", "we", "us", "you", "i", "me", "this",
    "that", "these", "those", "someone", "somebody", "anyone", "anybody", "everyone",
    "everybody", "nobody", "no one", "none", "unknown", "unnamed", "character",
    "characters", "two characters", "a character", "the character", "people",
    "first person", "second person", "third person", "all", "both", "together", "omnes",
    "dramatis personae", "the rest", "others", "the others"]

PLACE_PREDICATES = ["is", "are", "was", "were", "been", "being", "has", "have", "had",
                    "stands", "stood", "hangs", "hung", "lies", "sits", "leads", "opens",
                    "placed", "arranged", "stripped"]
RELATIVE_PRONOUNS = ["which", "that", "who", "whom", "where"]
PRODUCTION_MARKERS = ["omitted", "continued", "tbd", "deleted"]
TIME_WORDS = [
    "present", "past", "future", "morning", "afternoon", "evening", "night", "midnight",
    "noon", "dawn", "dusk", "daybreak", "sunrise", "sunset", "today", "tomorrow",
    "yesterday", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "hour", "hours", "minute", "minutes", "later", "earlier", "next", "last", "following",
    "same", "clock", "o'clock", "am", "pm", "a", "m", "p", "january", "february", "march",
    "april", "may", "june", "july", "august", "september", "october", "november",
    "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
    "sunday", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth",
    "ninth", "tenth", "eleventh", "twelfth"]
TIME_STOPWORDS = ["the", "of", "at", "on", "in", "and", "it", "is"]
CIRCUMSTANCE_OPENERS = ["in", "on", "at", "after", "before", "during", "towards", "toward",
                        "by"]
LOCATION_MAX_CHARS = 48

STOPWORDS = (
    "a an the this that these those there here and or but not of in on at to by "
    "as for with from into onto over about who whom whose what which when where "
    "why how is are was were be been being do does did done have has had will "
    "would can could shall should may might must it its he she they them him her "
    "his their our your we you i me my any all some each every both any one "
    "appear appears appeared appearing appearance appearances scene scenes "
    "script scripts line lines page pages show shows showing list lists listed "
    "name names named tell tells say says said does").split()

WORD_ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6,
    "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "one": 1, "two": 2, "three": 3,
    "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}

REVIEW_WARNING_CODES = ["ocr_derived", "no_indentation", "weak_screenplay_signal",
                        "low_format_confidence", "scene_limit", "unit_limit"]

FDX_PARAGRAPH_TYPES = {
    "scene heading": "scene_heading", "action": "action", "character": "character",
    "dialogue": "dialogue", "parenthetical": "parenthetical", "transition": "transition",
    "shot": "shot", "general": "action"}
FDX_IGNORED_TYPES = ["cast list", "new act", "end of act", "act break", "page break"]

OMITTED_HEADINGS = ["OMITTED", "SCENE OMITTED"]

# The operation that undoes each operation. Setting an attribute is
# undone by shape: by a set when a value was displaced, else by a removal.
INVERSE_OPERATIONS = {
    "add_assertion": "remove_assertion", "remove_assertion": "add_assertion",
    "update_assertion": "update_assertion", "set_unit_text": "set_unit_text",
    "remove_entity_attribute": "set_entity_attribute", "create_entity": "create_entity",
    "update_entity": "update_entity", "set_scene_omitted": "set_scene_omitted"}

# A scene whose reads differ by more assertions than this is flagged.
VARIANCE_THRESHOLD = 3
