"""Names and bounds of the data model."""

from __future__ import annotations

#: Enumerations in the order of their ordinals.
ORIGINS = ("observed", "discovered", "inferred", "reinforced", "hypothetical")
ROLES = ("mechanistic", "compressed", "analogical", "predictive", "causal", "contradicts", "supports", "supersedes")
BONDS = ("none", "sigma", "pi", "vanderwaals", "defect", "synthetic")
DEFECTS = ("none", "vacancy", "substitution", "stone-wales", "strain", "doped", "boundary")
LIFECYCLES = ("active", "refuted", "revoked", "superseded", "invalidated", "audit_only")

#: A version that no snapshot reaches.
FOREVER = 9223372036854775807

#: Caps on requests.
MOST_TOP_K, MOST_HOPS, MOST_PATHS, MOST_VISITED = 1000, 16, 256, 200_000

#: Core relations with aliases, then the types a subject and an object may have (empty: any).
RELATIONS = {
    "caused": (("causes", "caused_by", "resulted_in"), "", ""),
    "supports": (("supported_by", "evidence_for"), "", ""),
    "contradicts": (("conflicts_with", "opposes"), "", ""),
    "supersedes": (("replaces", "updates"), "", ""),
    "located_in": (("hosted_in", "deployed_to", "runs_in", "current_depot"), "", ""),
    "contains": (("includes", "holds"), "", ""),
    "depends_on": (("calls", "requires", "uses"), "", ""),
    "assigned_to": (("assigned_vehicle", "owned_by"), "", ""),
    "directed_by": (("director", "was_directed_by"), "work", "person"),
    "authored_by": (("author", "written_by"), "work", "person"),
    "mother": (("mother_of", "has_mother"), "person", "person"),
    "father": (("father_of", "has_father"), "person", "person"),
    "spouse": (("married_to", "wife", "husband"), "person", "person"),
}
