"""Weights, caps and keyword tables: data, to be replaced per corpus without touching an operator."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Element types and section kinds of the data model.
ELEMENT_TYPES = ("paragraph", "table", "heading", "list", "figure", "caption", "warning", "plate")
SECTION_KINDS = ("data", "procedure", "plate", "schedule", "other")
EDGE_TYPES = ("illustrates", "describes", "illustrates_step", "cross_ref", "references_section", "references_data", "references_procedure", "belongs_to", "applies_to", "superseded_by")

# Weights and caps of the ranking rules.
EXACT, KIND_PAIR, COMPONENT_PHRASE, PANEL, CROSS_REF, TABLE_CODE, SECTION_MATE = 40.0, 10.0, 18.0, 12.0, 6.0, 8.0, 7.0
MAX_PANELS, MAX_PAIRS, MAX_HOPS, MAX_TABLE_HOPS, MAX_MATES = 4, 8, 8, 4, 8
RRF_K, FUSED, RERANK_WINDOW, CITATIONS, DIAGRAMS = 60, 24, 16, 8, 6
LEXICAL, VISUAL, STRUCTURAL = 20, 12, 16

#: Function words of English by their grammatical class; a deployment in another language brings its own.
STOPWORDS = tuple(
    (
        "a an the "  # articles
        "i me my we us our you your he him his she her it its they them their this that these those who whom whose which what "  # pronouns
        "be am is are was were been being do does did done have has had having can could may might must shall should will would "  # auxiliaries
        "of in on at by for from to with without about into onto over under above below between among through during before after against within along across per via as than "  # prepositions
        "and or but nor so if then else because while when where why how whether though although until unless "  # conjunctions
        "not no yes also only just too very there here again still once more most some any all both each every few many much other another such same own "  # adverbs and determiners
        "please tell give find need want get let"  # what a request opens with
    ).split()
)
#: Names of measured quantities, what qualifies them, and unit symbols of the SI and in use with it.
QUANTITIES = "length width height depth thickness diameter radius angle area volume clearance gap backlash runout torque force load pressure temperature voltage current speed flow mass weight hardness roughness viscosity".split()
QUALIFIERS = "value limit tolerance dimension rating capacity nominal maximum minimum wear data".split()
UNITS = ("mm", "bar", "nm", "kg", "deg", "mpa", "kpa", "rpm")
DATA_WORDS = (*QUANTITIES, *QUALIFIERS, *UNITS, "cm", "kn", "kw")
#: Work on equipment: a verb and its noun each, as maintenance task codes name them.
PROCEDURE_WORDS = tuple("remove removal install installation assemble assembly disassemble disassembly dismantle dismantling mount mounting inspect inspection check checking test testing clean cleaning lubricate lubrication adjust adjustment repair replace replacement drain fill tighten loosen lift procedure step".split())
#: Of these, what by itself makes a question one for a procedure, and what may as well stand in a question for data.
ACTION_TOKENS = ("remove", "install", "replace", "drain", "lift", "step", "procedure")
FITTING_TOKENS = ("mount", "mounting", "dismantle", "dismantling")
#: What a question for a verdict turns on.
DECISION_WORDS = tuple("accept reject keep discard scrap reuse renew valid serviceable acceptable permissible allowed".split())
#: Kinds of picture.
FIGURE_WORDS = tuple("figure drawing diagram picture illustration photo image schematic sketch chart plate".split())
#: Words of recurrence.
SCHEDULE_WORDS = tuple("schedule interval periodic daily weekly monthly yearly hour due".split())
#: What a title says of the kind of a section, not of its subject.
ACTION_WORDS = ("data", "plate", "schedule", "procedure", "checking", "inspection", "dismantling", "mounting", "removal", "installation", "cleaning", "adjustment", "testing")
WEAK_TITLE_WORDS = (*ACTION_WORDS, "general", "unit")
KEEP_TOKENS = ("stay", "keep", "reuse", "scrap")
#: (cue in the question, word that lifts it, word in a title): -20 where a deployment knows that the one is never meant by the other.
EXCLUSIONS: tuple[tuple[str, str, str], ...] = ()
#: Words under which a text forbids or limits.
PROHIBITIONS = ("must not", "do not", "shall not", "never")

# Cues in texts and questions that results depend on.
VALUE_CUES = ("clearance", "diameter", "torque", "pressure", "wear", "mm", "bar", "nm", "kg", "max", "min")
SAFETY_CUES = ("shut off", "precaution", "safety check", "lubricating oil")
LIMIT_CUES = ("minute", "hour", "must not exceed", "keep under")
CAREFUL_QUESTIONS = ("shut off", "shut-off", "lubricat", "precaution", "safety", "mass", "lifting")
CAREFUL_TEXTS = ("shut off", "precaution", "safety check", "lubricating oil", "mass", "kg")
CALLOUTS = ("callout", "item no", "item description")
EXCLUDING = ("do not use", "don't use", "not the", "not from", "ignore", "avoid", "even if")
DOUBTING = ("even if", "do not", "correct", "looks familiar")
COMPARING = ("compare", "versus", "both sources", "same rule", "if they differ", "quote both")

# Identifier grammars, as patterns that Java and RE2 read alike.
PROCEDURE_PATTERN = r"[0-9]{3}-[0-9]+(?:\.[0-9]+)?"
PLATE_PATTERN = r"P[0-9]{4,6}"
DOC_CODE_PATTERN = r"[A-Z]{1,3}[0-9]{4,8}"
DRAWING_PATTERN = r"[A-Z]{1,3}[0-9]{3,6}-[0-9]{1,5}(?:\.[0-9]+)?"
TABLE_ROW_PATTERN = r"[A-Z][0-9]{2}-[0-9]{2}"


@dataclass(frozen=True)
class Settings:
    """What the engine takes from its surroundings, as plain parameters."""

    rrf_k: int = RRF_K
    fused: int = FUSED
    router_escalations: int = 60
    ocr_default: str = "ocr"
    abstain_text: str = "The manual does not support an answer to this question."

    @staticmethod
    def of(conf: dict[str, str], prefix: str = "tidemill.") -> Settings:
        """From settings such as Spark's, by name; what is not there keeps its default."""
        own = {f.name: conf[prefix + f.name] for f in fields(Settings) if prefix + f.name in conf}
        return Settings(**{k: type(getattr(Settings, k))(v) for k, v in own.items()})
