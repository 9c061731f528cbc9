"""tideline.sources"""
