"""Options with their defaults and bounds, from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, default, least, most.
NUMBERS = [
    ("MAX_FALLBACK_PAGES", 12, 1, 500),
    ("MAX_WORKERS", 4, 1, 64),
    ("GOOGLE_SAFE_INTERVAL", 0.8, 0.1, 10.0),
    ("GOOGLE_MAX_RETRIES", 5, 1, 10),
    ("DOMAIN_SCORE_THRESHOLD", 60, 0, 100),
    ("MAX_REDIRECTS", 5, 0, 100),
    ("MAX_URL_LENGTH", 2000, 100, 10000),
    ("CONNECTION_TIMEOUT", 10, 1, 120),
    ("READ_TIMEOUT", 20, 1, 120),
    ("MIN_CRAWL_DELAY", 0.5, 0.0, 60.0),
    ("MAX_CRAWL_DELAY", 2.0, 0.0, 60.0),
    ("MAX_URLS_PER_SITEMAP", 10000, 1, 100000),
]
PRIORITY_PARTS = "contact,about,impress,impressum,kontakt,privacy,sales,investor,procurement,suppliers,urea,adblue,europe,switzerland"
SITEMAP_NAMES = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap1.xml")
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def clamp(text: str | None, default, least, most):
    """A number within bounds; the default if it is none."""
    try:
        value = type(default)(text) if text is not None else default
    except ValueError:
        return default
    return max(least, min(most, value))


def clamp_column(text: Column, default: float, least: float, most: float) -> Column:
    value = text.try_cast("double")
    bounded = F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), value))  # both skip NULL
    return F.when(value.isNull(), F.lit(float(default))).otherwise(bounded)


def words(text: str, lower: bool = True) -> tuple[str, ...]:
    return tuple(x.strip().lower() if lower else x.strip() for x in text.split(",") if x.strip())


def words_column(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


@dataclass(frozen=True)
class Options:
    api_key: str = ""
    cx_id: str = ""
    numbers: Mapping[str, float] = field(default_factory=lambda: {n: d for n, d, _, _ in NUMBERS})
    process_pdfs: bool = False
    insecure_ssl: bool = False
    priority_parts: tuple[str, ...] = words(PRIORITY_PARTS)
    proxies: tuple[str, ...] = ()
    blocked_domains: tuple[str, ...] = ()
    sitemap_names: tuple[str, ...] = SITEMAP_NAMES

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> Options:
        flag = lambda n: env.get(n, "").strip().lower() in TRUE_WORDS
        return cls(
            api_key=env.get("GOOGLE_API_KEY", ""),
            cx_id=env.get("GOOGLE_CX_ID", ""),
            numbers={n: clamp(env.get(n), d, lo, hi) for n, d, lo, hi in NUMBERS},
            process_pdfs=flag("PROCESS_PDFS"),
            insecure_ssl=flag("ALLOW_INSECURE_SSL"),
            priority_parts=words(env.get("PRIORITY_PATH_PARTS", PRIORITY_PARTS)),
            proxies=words(env.get("PROXIES", ""), lower=False),
            blocked_domains=words(env.get("BLOCKED_DOMAINS", "")),
        )

    def __getitem__(self, name: str):
        return self.numbers[name]

    def as_dict(self) -> dict:
        return asdict(self) | {n.lower(): v for n, v in self.numbers.items()}

    def problems(self) -> list[str]:
        found = [f"{n} is missing" for n, v in (("GOOGLE_API_KEY", self.api_key), ("GOOGLE_CX_ID", self.cx_id)) if not v]
        if self["MIN_CRAWL_DELAY"] > self["MAX_CRAWL_DELAY"]:
            found.append("MIN_CRAWL_DELAY is over MAX_CRAWL_DELAY")
        return found

    def check(self) -> Options:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

    def updated(self, values: Mapping) -> Options:
        """Known names replaced; unknown ones are ignored."""
        own = {f.name for f in fields(self)}
        numbers = dict(self.numbers) | {k.upper(): v for k, v in values.items() if k.upper() in self.numbers}
        return replace(self, numbers=numbers, **{k: v for k, v in values.items() if k in own and k != "numbers"})


def read_settings(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and # comments go, quotes around a value and a leading ``export`` too."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            name, sign, value = line.removeprefix("export ").partition("=")
            if sign and not line.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out
