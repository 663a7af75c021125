"""docmill.llm"""
