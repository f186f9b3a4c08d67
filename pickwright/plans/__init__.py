"""The four pipelines, composed of the operators."""
