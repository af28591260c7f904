"""Small made-up code bases, for measurements and tests: services that call one another, in five languages."""

from __future__ import annotations

import os
import random

NOUNS = "order cart price user token invoice stock route session report filter cache event queue badge".split()
VERBS = "load save check build merge parse render send find drop".split()
EXTENSIONS = {"python": "py", "typescript": "ts", "go": "go", "rust": "rs", "ruby": "rb"}


def _title(*words: str) -> str:
    return "".join(w.capitalize() for w in words)


def _python(noun: str, other: str, names: list[str], called: list[str]) -> str:
    body = "".join(f'    def {n}(self, item: str, count: int = 1) -> str:\n        """{_title(*n.split("_"))} of a {noun}."""\n        if count > {i}:\n            return {c}(item, count - 1)\n        raise ValueError(item)\n\n' for i, (n, c) in enumerate(zip(names, called, strict=True)))
    free = "".join(f"def {n}_{noun}(item: str, count: int) -> str:\n    return {_title(noun)}Service().{n}(item, count)\n\n\n" for n in names)
    return f"import os\nfrom services.{other} import {', '.join(sorted(set(called)))}\n\nLIMIT = 10\n\n\nclass {_title(noun)}Service(Base{_title(other)}):\n    # The {noun}'s own rules.\n{body}\n{free}"


def _typescript(noun: str, other: str, names: list[str], called: list[str]) -> str:
    body = "".join(f"  async {n}(item: string, count = 1): Promise<string> {{\n    if (count > {i}) {{\n      return {c}(item, count - 1);\n    }}\n    throw new Error(item);\n  }}\n\n" for i, (n, c) in enumerate(zip(names, called, strict=True)))
    free = "".join(f"export function {n}_{noun}(item: string, count: number): Promise<string> {{\n  return new {_title(noun)}Service().{n}(item, count);\n}}\n\n" for n in names)
    return f"import {{ {', '.join(sorted(set(called)))} }} from './{other}';\n\n/** The {noun}'s own rules. */\nexport class {_title(noun)}Service extends Base{_title(other)} {{\n{body}}}\n\n{free}"


def _go(noun: str, other: str, names: list[str], called: list[str]) -> str:
    body = "".join(f"// {_title(*n.split('_'))} of a {noun}.\nfunc (s *{_title(noun)}Service) {_title(n)}(item string, count int) string {{\n\tif count > {i} {{\n\t\treturn {c}(item, count-1)\n\t}}\n\treturn item\n}}\n\n" for i, (n, c) in enumerate(zip(names, called, strict=True)))
    free = "".join(f"func {n}_{noun}(item string, count int) string {{\n\ts := {_title(noun)}Service{{}}\n\treturn s.{_title(n)}(item, count)\n}}\n\n" for n in names)
    return f'package services\n\nimport "fmt"\n\ntype {_title(noun)}Service struct {{\n\tBase{_title(other)}\n}}\n\n{body}{free}func show{_title(noun)}() {{ fmt.Println("{noun}") }}\n'


def _rust(noun: str, other: str, names: list[str], called: list[str]) -> str:
    body = "".join(f"    /// {_title(*n.split('_'))} of a {noun}.\n    pub fn {n}(&self, item: String, count: u32) -> String {{\n        if count > {i} {{\n            return {c}(item, count - 1);\n        }}\n        item\n    }}\n\n" for i, (n, c) in enumerate(zip(names, called, strict=True)))
    free = "".join(f"pub fn {n}_{noun}(item: String, count: u32) -> String {{\n    {_title(noun)}Service {{}}.{n}(item, count)\n}}\n\n" for n in names)
    return f"use crate::{other}::{{{', '.join(sorted(set(called)))}}};\n\npub struct {_title(noun)}Service {{}}\n\nimpl Base{_title(other)} for {_title(noun)}Service {{}}\n\nimpl {_title(noun)}Service {{\n{body}}}\n\n{free}"


def _ruby(noun: str, other: str, names: list[str], called: list[str]) -> str:
    body = "".join(f"  # {_title(*n.split('_'))} of a {noun}.\n  def {n}(item, count = 1)\n    if count > {i}\n      return {c}(item, count - 1)\n    end\n    raise ArgumentError, item\n  end\n\n" for i, (n, c) in enumerate(zip(names, called, strict=True)))
    free = "".join(f"def {n}_{noun}(item, count)\n  {_title(noun)}Service.new.{n}(item, count)\nend\n\n" for n in names)
    return f"require_relative '{other}'\n\nclass {_title(noun)}Service < Base{_title(other)}\n{body}end\n\n{free}"


WRITERS = {"python": _python, "typescript": _typescript, "go": _go, "rust": _rust, "ruby": _ruby}


def generate(root: str, language: str, files: int, seed: int = 1) -> int:
    """Writes `files` modules below root/services; returns the number of lines. The same for the same arguments."""
    rng, lines = random.Random(f"{language}{seed}"), 0
    folder = os.path.join(root, "services")
    os.makedirs(folder, exist_ok=True)
    modules = [NOUNS[i] if i < len(NOUNS) else f"{NOUNS[i % len(NOUNS)]}{i // len(NOUNS)}" for i in range(files)]
    for i, noun in enumerate(modules):
        other = modules[(i * 7 + 3) % files]
        names = rng.sample(VERBS, 4)
        text = WRITERS[language](noun, other, names, [f"{rng.choice(VERBS)}_{other}" for _ in names])
        with open(os.path.join(folder, f"{noun}.{EXTENSIONS[language]}"), "w") as f:
            f.write(text)
        lines += text.count("\n")
    return lines
