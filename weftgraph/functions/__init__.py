"""weftgraph.functions"""
