"""Training-data operators: one module per operator, registered in :mod:`corpusloom.llm.queries`.

Nothing outside this subpackage imports it, so the folder can be removed
without breaking the analytics library.
"""
