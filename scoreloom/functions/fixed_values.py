"""Word lists, patterns, constants and the concept catalogue that results depend on. Data, not logic.

Patterns are Java regular expressions, read case-insensitively with Unicode classes unless said otherwise.
"""

from dataclasses import dataclass


ABBREVIATIONS = ["approx", "cf", "dr", "e.g", "et al", "fig", "i.e", "n", "no", "nr", "prof", "sig", "vs"]
BULLET = r"^\s*(?:[-*•–—]|\(?\d{1,2}[.)])\s+"
#: Case-sensitive.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
NON_VERIFIABLE = (
    r"\b(?:recommend\w*|advis\w*|suggest\s+(?:clinical|further)|follow[-\s]?up|correlat\w*\s+clinical\w*|referral|"
    r"should\s+be\s+(?:considered|evaluated)|image\s+quality|scan\s+quality|motion\s+artifact\w*\s+limit\w*|"
    r"examination\s+(?:is\s+)?(?:technically\s+)?(?:adequate|suboptimal))\b"
)
CONJUNCTION = r",\s+(?:and|while|whereas)\s+(?=(?:the|a|an|there|no|both|bilateral|left|right)\b)"
CLAUSE_VERB = (
    r"\b(?:is|are|was|were|has|have|had|shows?|showed|appears?|presents?|demonstrates?|reveals?|extends?|involves?|"
    r"measures?|exhibits?|noted|observed|identified|seen|visible|detected|documented|evident|absent|present|confirmed)\b"
)
STOPWORDS_STATEMENT = "a an and are as at be been both by for from has have in is it its of on or that the there these this to was were with within".split()
STOPWORDS_ENTAILMENT = "a an and are as at be been both by for from has have in is it its of on or that the there these this to was were with within without no not".split()

SECTIONS = ["technique", "dentition", "periapical", "periodontal", "mandible", "maxilla", "sinus", "tmj", "other", "impression"]

#: Case-sensitive.
TOOTH_NUMBER = r"\b(?:tooth|teeth|element|elements|nn?\.?)\s*#?\s*((?:\d{2}[,\s/and]*)+)"
BARE_TOOTH = r"\b([1-4][1-8]|[5-8][1-5])\b"
MEASUREMENT = r"\b(\d+(?:[.,]\d+)?)\s*(mm|cm|millimet\w*|centimet\w*)\b"
LEFT = r"\b(?:left|sinistr\w*|lt\.?)\b"
RIGHT = r"\b(?:right|dextr\w*|rt\.?)\b"
BILATERAL = r"\b(?:bilateral\w*|both\s+sides?|on\s+both)\b"
NEGATION = r"\b(?:no|not|without|absence\s+of|absent|free\s+of|negative\s+for|unremarkable|neither|nor|denies|rules?\s+out|excluded)\b"
UNCERTAINTY = r"\b(?:possible|possibly|probable|probably|suspected|suspicious|apparent\w*|cannot\s+be\s+excluded|may\s+be|likely|questionable|equivocal|borderline)\b"

DANGLING = r"^\s*(?:it\b|they\b|the\s+(?:fifth|sixth|seventh|eighth)\s+tooth\b|a\s+prosthetic\s+crown\s+is\s+present)"
UNTRANSLATED = r"\be\.\s?d\.|\bn\.?n\.?\b|\bs\.?p\.?a\.?\b"
BACK_REFERENCE = r"\b(?:this|the)\s+(?:latter|former|same|aforementioned|said)\b|\bof\s+(?:this|that)\s+(?:tooth|element)\b"
COMPLETE_EDENTULISM = r"\b(?:complete|total)\s+edentul\w*|\bedentul\w*\s+(?:arch|mandible|maxilla)"
ABSENCE_CONCEPTS = ["missing_tooth", "edentulous"]
EXCLUSIVE = [["lingual", "buccal", "vestibular", "palatal"], ["completely", "partially", "minimally"], ["regular", "irregular"]]

ENTAILED_FROM = 0.62
ASSIGNED_FROM = 0.45

COVERAGE_VERB = r"inclu(?:ded|so|si\w*|sion)|represented|acquired|depicted|imaged|visible|assessable|evaluable|explorable|comprised|contained|scanned"
COVERAGE_SCOPE = r"scan\w*|acquisition|acquired|volume|field|examination|study|CT|FOV"

@dataclass(frozen=True)
class Concept:
    """A concept of the catalogue. covers: an anatomy of which a text says whether the scan has it, instead of patterns."""

    key: str
    section: str
    patterns: tuple[str, ...] = ()
    covers: str | None = None
    tooth_specific: bool = False
    lateralized: bool = False
    measurable: bool = False
    denotes_absence: bool = False


#: Concepts in the order in which texts are searched for them.
CATALOGUE = [
    Concept("cbct_study", "technique", patterns=(
        r"\bcone[-\s]?beam\b",
        r"\bCBCT\b",
        r"\bCT\s+scan\b",
    )),
    Concept("scan_coverage", "technique", patterns=(
        r"\bno\s+diagnostic\s+scans?\b",
        r"\bdiagnostic\s+scans?\b[^.]{0,30}\babsent\b",
        r"\bacquisition\s+(?:window|volume)\b",
    )),
    Concept("coverage_maxilla", "technique", covers=r"maxilla(?!ry\s+sinus)\w*|upper\s+jaw|palat\w*"),
    Concept("coverage_mandible", "technique", covers=r"mandible|mandibular\s+(?:body|bone|arch|ramus|branch)|lower\s+jaw|hemimandible"),
    Concept("coverage_condyle", "technique", covers=r"condyl\w*|coronoid|temporomandibular|\bTMJ\b"),
    Concept("coverage_sinus", "technique", covers=r"sinus\w*|antr\w*"),
    Concept("coverage_dentition", "technique", covers=r"dental\s+(?:element|arch)\w*|arches|crowns?\s+of\s+the"),
    Concept("field_of_view", "technique", patterns=(
        r"\bfield\s+of\s+view\b",
        r"\bFOV\b",
    )),
    Concept("edentulous", "dentition", tooth_specific=True, denotes_absence=True, patterns=(
        r"\bedentul\w*\b",
        r"\bmissing\s+teeth\b",
        r"\btoothless\b",
    )),
    Concept("missing_tooth", "dentition", tooth_specific=True, denotes_absence=True, patterns=(
        r"\b(?:absence|absent|missing|agenesis)\s+of\s+(?:the\s+)?(?:tooth|teeth|element)",
        r"\b(?:absence|absent|missing)\s+(?:\w+\s+){0,3}?(?:from|in)\s+the\s+arch",
        r"\bedentulism\s+involving\b",
        r"\bteeth\s+(?:\w+\s+){0,2}?(?:are\s+)?(?:missing|absent)\b",
        r"\bfollowing\s+teeth\b[^.]{0,24}?(?:missing|absent)",
        r"\btooth\s+\d{2}\s+is\s+(?:missing|absent)\b",
        r"\b\d{2}\s+(?:is\s+|are\s+)?(?:absent|missing)\b",
        r"\babsence\s+of\s+e\.?\s?d\.?",
        r"\bedentulous\s+(?:space|area|region|site)s?\b",
    )),
    Concept("impacted_tooth", "dentition", tooth_specific=True, patterns=(
        r"\bimpact(?:ed|ion)\b",
        r"\bunerupted\b",
        r"\bretained\s+(?:tooth|third\s+molar)\b",
        r"\b(?:tooth|teeth|element|elements|molars?|canines?|premolars?|incisors?)\s*(?:\d{2}[\s,and/]*)*[^.]{0,20}?\binclu(?:so|ded|sion)\b",
        r"\binclu(?:so|ded|sion)\b[^.]{0,20}?\b(?:tooth|teeth|element|elements)\b",
    )),
    Concept("third_molar", "dentition", tooth_specific=True, patterns=(
        r"\bthird\s+molars?\b",
        r"\bwisdom\s+(?:tooth|teeth)\b",
        r"\b(?:18|28|38|48)\b",
    )),
    Concept("residual_root", "dentition", tooth_specific=True, patterns=(
        r"\bresidual\s+roots?\b",
        r"\bretained\s+roots?\b",
        r"\broot\s+remnants?\b",
    )),
    Concept("caries", "dentition", tooth_specific=True, patterns=(
        r"\bcari(?:es|ous)\b",
        r"\bdecay\b",
    )),
    Concept("restoration", "dentition", tooth_specific=True, patterns=(
        r"\brestorations?\b",
        r"\bfillings?\b",
        r"\bcrowns?\b",
        r"\bprosthe\w*\b",
        r"\bbridge\b",
        r"\bonlay\b",
    )),
    Concept("endodontic", "dentition", tooth_specific=True, patterns=(
        r"\bendodontic\w*\b",
        r"\broot\s+canal\s+(?:treat|fill|therap)\w*\b",
        r"\bobturat\w*\b",
    )),
    Concept("dental_implant", "dentition", tooth_specific=True, patterns=(
        r"\bimplants?\b",
        r"\bfixtures?\b",
    )),
    Concept("complete_dentition", "dentition", tooth_specific=True, patterns=(
        r"\bcomplete\s+dentition\b",
        r"\bpresence\s+(?:in\s+the\s+arch\s+)?of\s+all\s+(?:the\s+)?dental\s+elements\b",
        r"\bteeth\s+from\s+\d{2}\s+to\s+\d{2}\s+are\s+present\b",
        r"\ball\s+(?:teeth|dental\s+elements)\s+(?:are\s+)?present\b",
    )),
    Concept("supernumerary", "dentition", tooth_specific=True, patterns=(
        r"\bsupernumerar\w*\b",
        r"\bmesiodens\b",
    )),
    Concept("malposition", "dentition", tooth_specific=True, patterns=(
        r"\bmalpositio\w*\b",
        r"\bectopic\w*\b",
        r"\bdystopic\b",
        r"\brotat(?:ed|ion)\b",
        r"\btipp(?:ed|ing)\b",
    )),
    Concept("periapical_lesion", "periapical", tooth_specific=True, patterns=(
        r"\bperiapical\s+(?:lesion|radiolucenc\w*|rarefaction|granulom\w*|process)\b",
        r"\bapical\s+(?:lesion|periodontitis|radiolucenc\w*)\b",
    )),
    Concept("cyst", "periapical", measurable=True, patterns=(
        r"\bcyst\w*\b",
        r"\bkeratocyst\w*\b",
        r"\bfollicular\s+lesion\b",
    )),
    Concept("root_resorption", "periapical", tooth_specific=True, patterns=(
        r"\broot\s+resorption\b",
        r"\bexternal\s+resorption\b",
        r"\binternal\s+resorption\b",
    )),
    Concept("sclerosis", "periapical", patterns=(
        r"\bsclero(?:sis|tic)\b",
        r"\bcondensing\s+osteitis\b",
        r"\bosteosclero\w*\b",
    )),
    Concept("bone_loss", "periodontal", measurable=True, patterns=(
        r"\bperiodontal\s+(?:bone\s+)?(?:loss|defect|disease)\b",
        r"\bperiodontit\w*\b",
        r"\b(?:horizontal|vertical|angular)\s+bone\s+loss\b",
        r"\bcrestal\s+bone\s+loss\b",
    )),
    Concept("osteolytic_lesion", "periapical", measurable=True, patterns=(
        r"\bosteolyt\w*\b",
        r"\bosteocondens\w*\b",
        r"\bosteorarefact\w*\b",
        r"\b(?:radiolucent|radiopaque)\s+(?:lesion|area|image|formation)s?\b",
        r"\bareas?\s+of\s+(?:bone\s+)?(?:condensation|rarefaction|osteorarefaction)\b",
    )),
    Concept("pericoronal_radiolucency", "periapical", tooth_specific=True, measurable=True, patterns=(
        r"\bpericoronal\b",
        r"\bfollicular\s+(?:sac|space|widening)\b",
    )),
    Concept("furcation", "periodontal", patterns=(
        r"\bfurcation\b",
    )),
    Concept("calculus", "periodontal", patterns=(
        r"\bcalculus\b",
        r"\btartar\b",
    )),
    Concept("mandibular_canal", "mandible", lateralized=True, patterns=(
        r"\bmandibular\s+canals?\b",
        r"\binferior\s+alveolar\s+(?:nerves?|canals?)\b",
        r"\balveolar\s+canals?\b",
        r"\bIAN\b",
    )),
    Concept("canal_proximity", "mandible", lateralized=True, measurable=True, patterns=(
        r"\b(?:close|proximity|contact|adjacen\w*|abut\w*|contigu\w*|near)\b[^.]{0,60}\b(?:mandibular|alveolar)\s+canals?\b",
        r"\b(?:mandibular|alveolar)\s+canals?\b[^.]{0,60}\b(?:close|proximity|contact|contigu\w*)\b",
        r"\b(?:in\s+)?(?:direct\s+)?(?:contact|continuity)\s+with\s+(?:the\s+)?(?:mandibular|alveolar)\s+canals?\b",
    )),
    Concept("canal_course", "mandible", lateralized=True, patterns=(
        r"\b(?:course|emergence|exits?|trajectory)\b[^.]{0,40}\bcanals?\b",
        r"\bcanals?\b[^.]{0,40}\b(?:course|emergence|foraminal\s+exits?|trajectory)\b",
        r"\bpredominantly\s+(?:lingual|buccal|vestibular|central)\b",
    )),
    Concept("mental_foramen", "mandible", lateralized=True, patterns=(
        r"\bmental\s+foram\w*\b",
    )),
    Concept("anterior_loop", "mandible", lateralized=True, patterns=(
        r"\banterior\s+loop\b",
    )),
    Concept("bifid_canal", "mandible", lateralized=True, patterns=(
        r"\bbifid\b",
        r"\bduplicat\w*\s+canal\b",
        r"\bretromolar\s+canal\b",
    )),
    Concept("mandibular_atrophy", "mandible", measurable=True, patterns=(
        r"\bmandibul\w*\b[^.]{0,40}\batroph\w*\b",
        r"\batroph\w*\b[^.]{0,40}\bmandibl\w*\b",
    )),
    Concept("lingual_concavity", "mandible", patterns=(
        r"\blingual\s+(?:concavit\w*|undercut)\b",
        r"\bsubmandibular\s+fossa\b",
    )),
    Concept("maxillary_atrophy", "maxilla", measurable=True, patterns=(
        r"\bmaxill\w*\b[^.]{0,40}\batroph\w*\b",
        r"\bridge\s+resorption\b",
        r"\breduced\s+(?:bone\s+)?(?:height|width|volume)\b",
    )),
    Concept("nasopalatine_canal", "maxilla", measurable=True, patterns=(
        r"\bnasopalatine\s+(?:canal|duct)\b",
        r"\bincisive\s+canal\b",
    )),
    Concept("nasal_cavity", "maxilla", patterns=(
        r"\bnasal\s+(?:cavit\w*|floor|fossa)\b",
        r"\bseptum\s+deviat\w*\b",
    )),
    Concept("bone_density", "maxilla", measurable=True, patterns=(
        r"\bbone\s+(?:densit\w*|qualit\w*|mineraliz\w*)\b",
        r"\btroph(?:ism|ic)\w*\b",
        r"\b(?:D[1-4]|type\s+[IVX]+)\s+bone\b",
        r"\btrabecular\s+bone\b",
        r"\bcortical\s+(?:bone|plate|thickness)\b",
    )),
    Concept("ridge_dimension", "maxilla", measurable=True, patterns=(
        r"\balveolar\s+(?:ridge|crest|process)\b",
        r"\bbone\s+(?:height|width)\b",
        r"\bresidual\s+ridge\b",
    )),
    Concept("maxillary_sinus", "sinus", lateralized=True, patterns=(
        r"\bmaxillary\s+sinus\w*\b",
        r"\bantrum\b",
        r"\bantral\b",
    )),
    Concept("mucosal_thickening", "sinus", lateralized=True, measurable=True, patterns=(
        r"\bmucosal?\s+thicken\w*\b",
        r"\bmucous\s+membrane\s+thicken\w*\b",
        r"\bsinus\s+mucos\w*\b",
    )),
    Concept("sinusitis", "sinus", lateralized=True, patterns=(
        r"\bsinusit\w*\b",
        r"\bopacif\w*\b",
        r"\bair[-\s]fluid\s+level\b",
        r"\bcomplete\s+opacit\w*\b",
    )),
    Concept("mucous_retention_cyst", "sinus", lateralized=True, measurable=True, patterns=(
        r"\bretention\s+(?:cyst|pseudocyst)\b",
        r"\bmucocele\b",
        r"\bpolyp\w*\b",
    )),
    Concept("sinus_septa", "sinus", lateralized=True, patterns=(
        r"\bsept(?:um|a)\b[^.]{0,30}\bsinus\b",
        r"\bsinus\b[^.]{0,30}\bsept(?:um|a)\b",
        r"\bunderwood\b",
    )),
    Concept("sinus_pneumatization", "sinus", lateralized=True, patterns=(
        r"\bpneumatiz\w*\b",
    )),
    Concept("oroantral_relation", "sinus", lateralized=True, patterns=(
        r"\broots?\b[^.]{0,50}\bsinus\b",
        r"\bsinus\s+floor\b[^.]{0,50}\broots?\b",
        r"\boroantral\b",
    )),
    Concept("tmj", "tmj", lateralized=True, patterns=(
        r"\btemporomandibular\b",
        r"\bTMJ\b",
        r"\bcondyl\w*\b",
        r"\bglenoid\s+fossa\b",
    )),
    Concept("condylar_degeneration", "tmj", lateralized=True, patterns=(
        r"\bcondyl\w*\b[^.]{0,50}\b(?:flatten\w*|erosion|osteophyt\w*|degenerat\w*|remodel\w*|irregular\w*|sclerot\w*)\b",
        r"\bdegenerative\s+(?:change|joint)\w*\b",
    )),
    Concept("condylar_asymmetry", "tmj", patterns=(
        r"\basymmetr\w*\b[^.]{0,40}\bcondyl\w*\b",
        r"\bcondyl\w*\b[^.]{0,40}\basymmetr\w*\b",
    )),
    Concept("airway", "other", patterns=(
        r"\bairway\b",
        r"\bpharyn\w*\b",
        r"\badenoid\w*\b",
        r"\bturbinate\w*\b",
    )),
    Concept("fracture", "other", patterns=(
        r"\bfractur\w*\b",
        r"\bdiscontinuit\w*\s+of\s+the\s+cortex\b",
    )),
    Concept("foreign_body", "other", patterns=(
        r"\bforeign\s+bod\w*\b",
        r"\bradiopaque\s+material\b",
        r"\bextruded\s+(?:material|cement)\b",
        r"\bsurgical\s+(?:plate|screw|mesh)\b",
    )),
    Concept("bone_graft", "other", patterns=(
        r"\bgraft\w*\b",
        r"\bsinus\s+lift\b",
        r"\baugmentation\b",
        r"\bbiomaterial\b",
    )),
    Concept("osteonecrosis", "other", patterns=(
        r"\bosteonecro\w*\b",
        r"\bMRONJ\b",
        r"\bsequestr\w*\b",
    )),
    Concept("tonsillolith", "other", patterns=(
        r"\bcalcification\w*\b",
        r"\btonsillolith\w*\b",
        r"\bcarotid\s+calcif\w*\b",
        r"\bsialolith\w*\b",
    )),
    Concept("artifact", "other", patterns=(
        r"\bartifact\w*\b",
        r"\bscatter\b",
        r"\bbeam\s+hardening\b",
        r"\bmotion\b",
    )),
    Concept("no_significant_finding", "impression", patterns=(
        r"\bno\s+(?:significant|relevant|evident|obvious)\s+(?:abnormalit\w*|finding\w*|patholog\w*|lesion\w*)\b",
        r"\bwithin\s+normal\s+limits\b",
        r"\bunremarkable\b",
    )),
]

# Seven terms of the legacy diagnostic.
LEGACY_TERMS = {
    "implant": r"\bimplants?\b",
    "sinus": r"\b(?:maxillary\s+)?sinus(?:es)?\b",
    "canal": r"\b(?:mandibular|alveolar)\s+canal\b",
    "bone": r"\bbone\b",
    "lesion": r"\b(?:lesion|radiolucenc\w*|cyst\w*)\b",
    "impaction": r"\b(?:impacted|impaction)\b",
    "edentulous": r"\bedentul\w*\b",
}
