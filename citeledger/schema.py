"""Row types and closed vocabularies of reference reconciliation."""

NAME = "struct<family:string,given:string,literal:string,collective:boolean,et_al:boolean>"
REFERENCE = (
    "pos bigint, key string, locator string, kind string, doi string, pmid string, arxiv string, isbn string, url string, "
    f"title string, authors array<{NAME}>, year int, container string, volume string, issue string, pages string, "
    "publisher string, raw string"
)
RECORD = (
    f"identifier string, source string, doi string, title string, authors array<{NAME}>, "
    "years array<struct<slot:string,year:int>>, container string, container_short string, "
    "container_alternates array<string>, volume string, issue string, pages string, publisher string, kind string, "
    "retracted boolean, retraction_kind string"
)
#: (name, type) of a record's columns, and a record as one struct
RECORD_FIELDS = [tuple(f.split(" ", 1)) for f in RECORD.replace(", ", "\n").split("\n")]
RECORD_STRUCT = f"struct<{','.join(f'{name}:{kind}' for name, kind in RECORD_FIELDS)}>"
ISSUE = "struct<field:string,kind:string,severity:string,stored:string,registry:string,source:string,note:string>"

REGISTRIES = ["crossref", "datacite", "pubmed"]
VERDICTS = (
    "RETRACTED BAD-ID WRONG-WORK FIELD-MISMATCH UNCONFIRMED UNCHECKED DISPUTED INCOMPLETE ADJUDICATED "
    "REGISTRY-ARTIFACT TITLE-DRIFT COSMETIC OK"
).split()
FAILING = VERDICTS[:5]
ARTIFACT, SUPPRESSED = "registry-artifact", "suppressed:"

#: internal kind -> the type names that mean it
KIND_NAMES = {
    "article": "article article-journal conference conferencepaper inproceedings journal-article journalarticle "
    "paper-conference proceedings-article",
    "book": "book booklet edited-book monograph reference-book",
    "chapter": "book-chapter book-part book-section bookchapter booksection chapter inbook incollection",
    "dataset": "dataset",
    "preprint": "manuscript posted-content preprint unpublished",
    "report": "manual report report-component techreport",
    "thesis": "dissertation mastersthesis phdthesis thesis",
    "webpage": "blogpost electronic online post-weblog webpage",
}
KINDS = {name: kind for kind, names in KIND_NAMES.items() for name in names.split()}
COMPATIBLE_KINDS = [("article", "preprint"), ("book", "chapter"), ("preprint", "report")]

#: how bad a notice is, worst first
NOTICE_RANK = "retraction withdrawal removal correction expression-of-concern".split()
NO_RETRACTION_SIGNAL, NO_RESOLUTION_SIGNAL = ["datacite", "openlibrary"], ["retraction-watch"]
CONCERN = "expression of concern"
