"""Weights, thresholds and the rule catalogue."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Weights:
    """The shares of the five dimensions in the overall score."""

    complexity: float = 0.25
    duplication: float = 0.15
    coupling: float = 0.25
    cohesion: float = 0.15
    smells: float = 0.20


@dataclass(frozen=True)
class Thresholds:
    """Where the rules begin to fire."""

    long_method_loc: int = 30
    long_method_complexity: int = 10
    god_class_methods: int = 10
    god_class_loc: int = 200
    deep_nesting_depth: int = 4
    long_parameter_list: int = 5
    excessive_complexity: int = 15
    high_wmc: int = 50
    low_cohesion_ratio: float = 0.3
    hub_fan_in: int = 8
    magic_number_min: int = 2
    long_boolean_operators: int = 4
    large_match_cases: int = 8
    commented_code_lines: int = 3
    todo_limit: int = 5
    data_class_methods: int = 2
    lazy_class_loc: int = 15
    primitive_obsession_params: int = 5
    god_function_loc: int = 80
    god_function_complexity: int = 15
    unstable_instability: float = 0.8
    god_package_files: int = 20
    god_package_loc: int = 2000
    scattered_fan_out: int = 8
    large_binary_bytes: int = 2 * 1024 * 1024


def merged(defaults, **given):
    """Defaults with the given values in their place; unknown names fail."""
    return replace(defaults, **{k: v for k, v in given.items() if v is not None})


#: Rule, category, default severity, languages.
RULES = [
    ("god-class", "design", "minor", "all"),
    ("long-method", "size", "minor", "all"),
    ("deep-nesting", "complexity", "minor", "all"),
    ("long-parameter-list", "size", "minor", "all"),
    ("excessive-complexity", "complexity", "major", "all"),
    ("high-wmc", "design", "minor", "all"),
    ("low-cohesion", "cohesion", "minor", "all"),
    ("hub-dependency", "coupling", "minor", "all"),
    ("empty-catch", "design", "major", "python"),
    ("magic-numbers", "design", "info", "python"),
    ("long-boolean-expression", "complexity", "minor", "python"),
    ("large-match", "design", "minor", "python"),
    ("commented-out-code", "design", "info", "python"),
    ("todo-accumulation", "design", "info", "python"),
    ("data-class", "design", "info", "python"),
    ("lazy-class", "design", "info", "python"),
    ("primitive-obsession", "design", "info", "python"),
    ("god-function", "size", "major", "python"),
    ("cyclic-dependencies", "coupling", "major", "all"),
    ("unstable-dependency", "coupling", "minor", "all"),
    ("god-package", "design", "minor", "all"),
    ("scattered-functionality", "coupling", "minor", "all"),
    ("cross-layer-skip", "design", "major", "all"),
    ("missing-readme", "design", "info", "all"),
    ("missing-ci", "design", "info", "all"),
    ("missing-linter-config", "design", "info", "all"),
    ("missing-lockfile", "design", "minor", "all"),
    ("build-artifacts-committed", "design", "minor", "all"),
    ("large-binary-file", "design", "minor", "all"),
    ("spring-layer-skip", "design", "major", "java"),
    ("spring-service-cycle", "coupling", "major", "java"),
]
SEVERITIES = ("critical", "major", "minor", "info")
#: What a finding of each severity costs, per 1000 lines.
SEVERITY_COST = {"critical": 25.0, "major": 6.0, "minor": 1.5, "info": 0.3}


def rule(rule_id: str) -> tuple[str, str, str, str]:
    """The catalogue's entry of a rule; an unknown one is an error."""
    for r in RULES:
        if r[0] == rule_id:
            return r
    raise KeyError(rule_id)
