"""docmill.streaming"""
