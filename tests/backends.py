"""A model for tests of flows that need some answer."""

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Echo:
    """Fills the schema: text fields with the prompt, numbers with its length, choices with the first."""

    name: str = "echo"

    def load(self):
        pass

    def generate(self, prompts, schema, options):
        def fill(spec, prompt):
            if "enum" in spec:
                return spec["enum"][0]
            return {"string": prompt, "integer": len(prompt), "number": float(len(prompt)), "boolean": True, "array": [], "object": {}}.get(spec.get("type"))

        return [[json.dumps({k: fill(v, p) for k, v in schema["properties"].items()})] for p in prompts]
