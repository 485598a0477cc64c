"""Registries, thresholds and other fixed values that results depend on."""

from __future__ import annotations

#: Registries by short name, with the least downloads of a popular package, or the greatest rank where a low one is popular.
POPULAR_AT_LEAST = {"npm": 5000, "pypi": 5000, "ruby": 5000, "nuget": 5000, "hf": 1000}
POPULAR_AT_MOST = {"maven": 10, "golang": 4}
REGISTRIES = (*POPULAR_AT_LEAST, *POPULAR_AT_MOST)
#: What separates the words of a name.
DELIMITERS = r"[-_ .~@/:]+"
#: Other spellings of registries.
ALIASES = {"gem": "ruby", "rubygems": "ruby", "go": "golang", "pip": "pypi", "huggingface": "hf"}
#: Namespaces that are trusted, by registry; a file can replace them.
TRUSTED_NAMESPACES = {
    "npm": ["angular", "angular-devkit", "azure", "babel", "google", "google-cloud", "microsoft", "nestjs", "oxc-parser", "oxc-resolver", "react", "typescript", "vue", "nolyfill", "types"],
    "maven": ["com.fasterxml", "com.google", "org.apache", "org.hibernate", "org.junit", "org.slf4j", "org.springframework"],
    "golang": ["cloud.google.com", "github.com/golang", "github.com/kubernetes", "golang.org", "google.golang.org", "k8s.io"],
    "hf": ["deepmind", "facebook", "google", "huggingface", "microsoft", "nvidia", "openai"],
}
#: Neighbour search.
VECTOR_OVER, AUTHOR_OVER, PART_OVER, NEAR_EDITS, GROUP_EDITS, FLAT_LIMIT, KEPT, LEAST_SIMILARITY = 0.8, 0.9, 0.99, 3, 4, 10, 2, 0.85
#: Points of the risk score; its bounds; below these it is low, medium.
RISK = {"adversarial": 8, "suspicious": 10, "no_readme": 3, "bare_metadata": 2, "active": -1, "obvious": -18, "fork": -2, "test": -5, "distinct": -18, "known": -18, "overlap": -18, "relocated": -18}
RISK_MOST, RISK_LOW, RISK_MEDIUM = 10, 5, 8
#: Substitutions of look-alikes, tried in this order.
LOOKALIKES = (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "b"), ("7", "t"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("i", "l"), ("l", "i"))
#: Words of two names are alike over this overlap; what a name within the other counts from; what more like words, their order and their ends add.
PART_LIKE, PART_INSIDE, PART_MORE, PART_ORDER, PART_END = 0.5, 0.7, 0.3, 0.2, 0.1
