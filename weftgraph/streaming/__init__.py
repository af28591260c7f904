"""weftgraph.streaming"""
