"""Operators for preparing training text: one module per operator, registered by ``readweave.llm.queries``."""
