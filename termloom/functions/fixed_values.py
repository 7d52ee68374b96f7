"""Names, constants and patterns that results depend on, stated as they are."""

# Predicates read when shaping ontology terms.
OBO_PREFIX = "http://purl.obolibrary.org/obo/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
OWL_CLASS = "http://www.w3.org/2002/07/owl#Class"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_SUBCLASS_OF = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
EDITOR_LABEL = "http://purl.obolibrary.org/obo/IAO_0000111"
DEFINITION = "http://purl.obolibrary.org/obo/IAO_0000115"
# Synonym predicates in order of precedence.
SYNONYM_PREDICATES = (
    "http://purl.obolibrary.org/obo/IAO_0000118",
    "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasRelatedSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasBroadSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasNarrowSynonym",
)

# Score weights of the four similarity channels, and the exact-name bonus.
WORD_VALUE_WEIGHT = 0.45
CHAR_VALUE_WEIGHT = 0.35
WORD_CONTEXT_WEIGHT = 0.12
CHAR_CONTEXT_WEIGHT = 0.08
EXACT_NAME_BONUS = 1.0

# Separator of repeated values, and words left out of prompt text.
REPEAT_SEPARATOR = " | "
PROMPT_MISSING_WORDS = ("NA", "N/A", "NONE", "NULL", "NAN")

# Text that the common TSV reader takes as null.
TSV_NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Container columns whose keys carry no prefix, and accession keys.
UNPREFIXED_COLUMNS = ("attributes", "identifiers", "links")
ACCESSION_COLUMN = "accession"
ACCESSION_FALLBACK_KEYS = ("accession", "id.BioSample")

# Limits of the grounding payload.
PAYLOAD_CANDIDATES = 5
PAYLOAD_SYNONYMS = 8
PAYLOAD_DEFINITION_CHARS = 160

# Reasons written into annotations and skipped stages.
REASON_NOT_SELECTED = "No supplied candidate selected"
REASON_BAD_INDEX = "LLM selected an invalid candidate index; rejected by validator"
REASON_SELECTED = "Selected retrieved candidate "
REASON_NO_RESPONSE = "No grounding response returned for this concept"
REASON_ABSENT_ID = "LLM selected an ID absent from retrieved candidates; rejected by validator"
SKIP_EMPTY_METADATA = "No non-empty metadata fields"
SKIP_NO_EXTRACTION = "Extraction not available"
SKIP_NO_CONCEPTS = "No extracted concepts; production skips grounding"
SKIP_PREVIOUS_STAGE = "Previous stage failed: "
REFUSED_OUTPUT = "Truncated, malformed, schema-invalid or incomplete model output"
EXTRACTION_PROMPT_HEAD = "Metadata record:\n"
GROUNDING_PROMPT_HEAD = "Original metadata:\n"
GROUNDING_PROMPT_MIDDLE = "\n\nExtracted concepts and retrieved candidates:\n"
