"""docmill.sources"""
