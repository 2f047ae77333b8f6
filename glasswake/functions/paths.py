"""Classification of file paths in a change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values -----------------------------------------------------------
TEST_PARTS = (".test.", ".spec.", "/__tests__/", "/tests/", "/test/")
CONFIG_PARTS = ("/config/", ".config.", ".env.", "dockerfile", ".docker", "docker-compose")
CONFIG_ENDS = (".env", ".json", ".yaml", ".yml", ".toml", ".ini", ".properties")
NOISE_PARTS = ("package-lock", "yarn.lock", "pnpm-lock", "changelog", "license")
NOISE_ENDS = (".md", ".txt", ".css", ".scss", ".less", ".svg", ".png", ".jpg", ".jpeg",
              ".gif", ".ico", ".lock")
TEST_FILE = r"(__tests__|\.test\.|\.spec\.|/tests/|/test/)"
CODE_FILE = r"\.(ts|tsx|js|jsx|py|go|rb|java|cs|php|swift|kt)\z"
SERVICE_DIRS = ("service", "services", "controller", "controllers", "handler", "handlers",
                "api", "routes", "router", "domain", "usecase", "usecases", "use-case",
                "middleware", "validator", "validation")


def _any(path: Column, parts=(), ends=()) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | path.contains(p)
    for e in ends:
        out = out | path.endswith(e)
    return out


def file_class(path: Column) -> Column:
    """tests, config, noise or logic; the first that fits wins."""
    p = F.lower(path)
    return (F.when(_any(p, TEST_PARTS), "tests")
            .when(_any(p, CONFIG_PARTS, CONFIG_ENDS), "config")
            .when(_any(p, NOISE_PARTS, NOISE_ENDS), "noise").otherwise("logic"))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_logic(path: Column) -> Column:
    return ~is_test(path) & path.rlike(CODE_FILE)


def is_service(path: Column) -> Column:
    return path.rlike("(?i)/(" + "|".join(SERVICE_DIRS) + ")/")


def base_name(path: Column) -> Column:
    """Last path segment without its last extension."""
    return F.substring_index(F.regexp_replace(path, r"\.[^.]+\z", ""), "/", -1)
